"""PII (operator 7): patterns and information-theoretic sanitisation, in DataFrame functions only.

Patterns give the protected entities: each address or number is one. The distinct terms of a document, the words of
what the patterns leave of its whole text, tell what is written with its entities. Over the whole corpus, N documents,
an entity e in df(e) of them and a term t in df(t), with c(e, t) documents that have both, the chance of e where t is
read is P = (c + a p) / (df(t) + a) for p = df(e) / N: `prior` documents (a) without evidence are read with each term.
The term discloses log2(P / p) of the entity's log2(1 / p) bits. From `disclosure` of them on, every occurrence of the
term in the entity's documents is sanitised. A term has a hierarchy of classes: words with its first STEMS characters
(longest first), then words of its shape ([word], or [number] for one with a digit). It is generalised to the first
class that is itself under the threshold for all of the document's entities, counted over the corpus in the same
way, and removed where no class is. Every entity and every pair is scored, those of one document too; the fewer
documents, the more P is drawn to p.

Defined cases: a null text is the empty text; repeated rows count as documents of their own and get equal results;
rows that share a doc_id with other texts are told apart by the text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.llm.spans import counted, joined, matches, named, rewritten
from inkspark.llm.words import apart
from inkspark.sources.shared import written

#: The kinds in the order of reports and their patterns. Possessive repeats match what greedy ones
#: would, as nothing of their class can follow, and take long digit runs without recursion; a card run has its least
#: length here. A run that fails from its start (or the last match's end) fails from everywhere in it, so email and ip
#: try it once: the time is linear in a text without breaks.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20\-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
CARD, PHONE = (16, 19), (8, 15)  # digits
PRIOR, DISCLOSURE = 1.0, 0.8  # documents; share of the entity's bits
WORD = r"[\p{L}\p{N}]+"
STEMS = (5, 3)  # characters of the classes of words between a word and its shape, longest first
LEVELS = len(STEMS) + 1  # classes above the word itself
NAMED = "array<struct<order:int,kind:string,start:bigint,end:bigint>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum ends in 0."""
    value = lambda c: c.cast("int")
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, value(c)).otherwise(value(c) * 2 - F.when(value(c) > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def found(text: Column) -> dict[str, Column]:
    """The spans of each kind, those that fail their check left out."""
    spans = {k: matches(text, p) for k, p in PATTERNS.items()}
    return {
        "email": spans["email"],
        "ip": F.filter(spans["ip"], lambda s: F.forall(F.split(s["match"], r"\."), lambda p: F.rlike(p, F.lit("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$")))),
        "card": F.filter(spans["card"], lambda s: F.length(_digits(s["match"])).between(*CARD) & luhn(F.substring(_digits(s["match"]), 1, CARD[1]))),
        "phone": F.filter(spans["phone"], lambda s: F.length(_digits(s["match"])).between(*PHONE)),
    }


def _masked(text: Column, spans: Column) -> Column:
    """`text` with a space for each code point of the spans: terms are the words of what patterns leave."""
    last = lambda a: F.get(a, F.size(a) - 1)
    over = lambda a, s: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    step = lambda a, s: F.when((F.size(a) > 0) & (last(a)["end"] > s["start"]), over(a, s)).otherwise(F.concat(a, F.array(s)))
    apart = F.aggregate(ordered, F.filter(ordered, lambda s: F.lit(False)), step)
    return rewritten(text, F.transform(apart, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int")).alias("to"))))


def _levels(word: Column) -> list[Column]:
    """A word and its classes, hashed, each level apart; a word shorter than a stem is its own stem."""
    low = F.lower(word)
    shape = F.when(F.rlike(low, F.lit(r"\p{N}")), "[number]").otherwise("[word]")
    return [F.xxhash64(F.lit(i), x) for i, x in enumerate([low, *(F.substring(low, 1, n) for n in STEMS), shape])]


def _terms(text: Column) -> Column:
    """The distinct terms of a text and their classes, hashed."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(*_levels(w)))))


def _placed(text: Column, told: Column) -> Column:
    """start, end, to of every occurrence of terms in `told`; the fold grows by these only, not by all words.

    A term goes to its first class that isn't in `told` itself, and to nothing where all are."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(w.alias("w"), F.map_contains_key(told, _levels(w)[0]).alias("told")))
    gaps = F.slice(F.split(text, WORD, -1), F.lit(1), F.size(words))
    each = F.zip_with(gaps, words, lambda g, w: F.struct(F.length(g).cast("long").alias("gap"), w["w"].alias("w"), w["told"].alias("told")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,w:string>>").alias("out"))
    found = lambda a, x: F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + F.length(x["w"])).alias("end"), x["w"].alias("w"))
    step = lambda a, x: F.struct((a["at"] + x["gap"] + F.length(x["w"])).alias("at"), F.when(x["told"], F.concat(a["out"], F.array(found(a, x)))).otherwise(a["out"]).alias("out"))
    shown = lambda w: [*(F.when(F.length(w) > n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS), F.when(F.rlike(w, F.lit(r"\p{N}")), "[number]").otherwise("[word]")]
    safe = lambda w: F.coalesce(*(F.when(~F.map_contains_key(told, h), x) for h, x in zip(_levels(w)[1:], shown(w), strict=True)), F.lit(""))
    return F.transform(F.aggregate(each, start, step, lambda a: a["out"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), safe(s["w"]).alias("to")))


def mentions(docs: DataFrame) -> DataFrame:
    """Of documents with any: doc_id, text_key, spans, rest (the masked text), its terms, and those gained and lost by it."""
    whole = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    whole = whole.filter(F.rlike("text", F.lit(r"[0-9@]")))
    entity = {"email": lambda s: F.lower(s["match"]), "ip": lambda s: s["match"], "card": lambda s: _digits(s["match"]), "phone": lambda s: _digits(s["match"])}

    def shaped(i: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(i).alias("order"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(F.lit(kind), entity[kind](s)).alias("entity")))

    with_spans = whole.withColumn("spans", F.concat(*(shaped(i, k, spans) for i, (k, spans) in enumerate(found(F.col("text")).items())))).filter(F.size("spans") > 0)
    masked = with_spans.withColumn("rest", _masked(F.col("text"), F.col("spans"))).withColumns({"terms": _terms(F.col("rest")), "all": _terms(F.col("text"))})
    return masked.select("doc_id", "text_key", "spans", "rest", "terms", F.array_except("terms", "all").alias("gained"), F.array_except("all", "terms").alias("lost"))


def disclosing(docs: DataFrame, spans: DataFrame, prior: float, disclosure: float) -> DataFrame:
    """doc_id, text_key, told (a map with the disclosing terms and classes of each document as keys).

    Entities of the same documents have the same counts with every term and are one: a document of many entities does
    not multiply them with its terms.
    """
    at = ["doc_id", "text_key"]
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    one = written(spans.groupBy(*at).agg(F.count(F.lit(1)).alias("copies"), F.first(F.array_distinct("spans.entity")).alias("entities"), F.first("terms").alias("terms")), "pii-documents")
    entities = one.select(*at, "copies", F.explode("entities").alias("entity"))
    place = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), *at))
    classes = entities.groupBy("entity").agg(F.sum("copies").alias("df_e"), place(1).alias("a"), place(2).alias("b")).select("entity", "df_e", F.xxhash64("df_e", "a", "b").alias("class"))
    held = entities.join(classes, "entity").select(*at, "copies", "class", "df_e").distinct()
    held = held.groupBy(*at, "copies").agg(F.collect_list(F.struct("class", "df_e")).alias("classes"))
    met = held.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "classes").join(one, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")))
    together = written(met.select(*at, "copies", F.explode("classes").alias("of"), "terms").select(*at, "copies", "of.class", "of.df_e", F.explode("terms").alias("term")), "pii-together")
    pairs = together.groupBy("class", "df_e", "term").agg(F.sum("copies").alias("c"))
    # Each row counts the terms of its text; documents with mentions then change to those of the masked text.
    words = docs.select(F.lit(1).cast("long").alias("n"), F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term"))
    changes = spans.select(F.explode(F.concat(F.transform("gained", lambda t: F.struct(F.lit(1).cast("long").alias("n"), t.alias("term"))), F.transform("lost", lambda t: F.struct(F.lit(-1).cast("long").alias("n"), t.alias("term"))))).alias("x")).select("x.n", "x.term")
    df_term = words.union(changes).groupBy("term").agg(F.sum("n").alias("df_t"))
    p = F.col("df_e") / F.col("total")
    bits = F.log2((F.col("c") + prior * p) / ((F.col("df_t") + prior) * p))
    told = pairs.join(df_term, "term").crossJoin(F.broadcast(total)).filter(F.col("total") > F.col("df_e")).filter(bits >= disclosure * F.log2(1 / p))
    told = written(told.select("class", "term"), "pii-told")
    hits = together.join(told, ["class", "term"]).select(*at, "term").distinct()
    return hits.groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct("term", F.lit(True)))).alias("told"))


def detected(docs: DataFrame, prior: float = PRIOR, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, text_key, spans (order, kind, start, end) of each row: patterns' and, as kind `term`, disclosing
    words; placed: start, end and to, what stands for them (nothing where they are removed)."""
    spans = written(mentions(docs), "pii")
    at = ["doc_id", "text_key"]
    told = disclosing(docs, spans, prior, disclosure).withColumnsRenamed({c: f"_t_{c}" for c in at})
    found = spans.select(*at, "spans", "rest").dropDuplicates(at).join(told, F.col("doc_id").eqNullSafe(F.col("_t_doc_id")) & (F.col("text_key") == F.col("_t_text_key")), "left")
    marks = found.select(*(F.col(c).alias(f"__{c}") for c in at), "spans", F.when(F.col("told").isNotNull(), _placed(F.col("rest"), F.col("told"))).alias("placed"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    both = rows.join(marks, rows["doc_id"].eqNullSafe(F.col("__doc_id")) & (F.col("text_key") == F.col("__text_key")), "left")
    own = F.transform("spans", lambda s: F.struct(s["order"].alias("order"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast(NAMED)
    return both.select("doc_id", "text_key", F.concat(F.coalesce(own, none), F.coalesce(named(F.col("placed"), "term", len(PATTERNS)), none)).alias("spans"), F.coalesce("placed", F.array().cast("array<struct<start:bigint,end:bigint,to:string>>")).alias("placed"))


def digests(marked: DataFrame) -> DataFrame:
    own = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [counted(F.col("spans"), k) for k in PATTERNS]
    gone = F.size(F.filter("placed", lambda t: t["to"] == "")).cast("long")
    return marked.select("doc_id", *counts, F.sha2(joined(own, "order", "start"), 256).alias("base_sha256"), joined(F.col("spans"), "order", "start").alias("spans"), F.size("placed").cast("long").alias("n_term"), gone.alias("n_removed"))


def sanitised(docs: DataFrame, prior: float = PRIOR, disclosure: float = DISCLOSURE) -> DataFrame:
    """`docs` with their columns, whatever their names; in text, patterns stand as their kind, generalised terms as
    their class, removed ones go.

    Where spans of different kinds overlap, the one that starts first (then the earlier kind) stands for both.
    """
    i, k, spans, placed = apart(docs, "id", "key", "spans", "placed")
    marked = detected(docs, prior, disclosure).dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias(i), F.col("text_key").alias(k), F.col("spans").alias(spans), F.col("placed").alias(placed))
    met = docs.join(marked, docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"]) == F.col(k)), "left")
    to = F.map_from_entries(F.transform(placed, lambda t: F.struct(t["start"], t["to"])))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = lambda a, s: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] > s["start"]), a).otherwise(F.concat(a, F.array(s)))
    first = F.aggregate(ordered, F.filter(ordered, lambda s: F.lit(False)), step)
    named_ = F.transform(first, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["kind"] == "term", F.element_at(to, s["start"])).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]"))).alias("to")))
    text = F.when(F.size(spans) > 0, rewritten(docs["text"], named_)).otherwise(docs["text"])
    return met.select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns))
