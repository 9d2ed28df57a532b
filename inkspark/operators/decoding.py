"""Reading-to-text decoding under a language model: beams of all cases at once, one end position after another.

A position's hypotheses are a written table; the next ones join it with the lexicon's arcs, and each step asks the
model for its distinct grams only. Plans so stay of one size however long a case is, and cases, not positions, are what
a cluster spreads. Readings may be corrected by one edit a path, and a script guard may refuse hypotheses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkspark.functions import phonetics as ph
from inkspark.functions import text as tx
from inkspark.operators import cases as case_ops
from inkspark.sources.shared import written

#: A language model: distinct grams (g1 .. g<order>, the last token's suffixes) to the same with p.
Model = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Settings:
    """Hypotheses kept a position and texts returned; the lexicon's entries a span (all where None), and corrected
    ones; alternatives of a syllable; hypotheses kept beside the beam by lexical score; whether tones are free in
    lookups, and whether the beam goes by lexical score; the linear score's weights."""

    beam: int = 48
    nbest: int = 20
    per_span: int | None = None
    edit_entries: int = 8
    edit_alternatives: int = 24
    lexical_slots: int = 0
    tone_variants: bool = False
    prune_by_lexical: bool = False
    corpus_weight: float = 1.0
    lexical_weight: float = 1.0
    cost_weight: float = 1.0
    order: int = 3

    def __post_init__(self) -> None:
        if min(self.beam, self.nbest, self.edit_entries, self.edit_alternatives, self.per_span or 1, self.order) < 1 or self.lexical_slots < 0:
            raise ValueError("counts must be at least 1, slots at least 0")


def history(left_context: Column | str, order: int) -> Column:
    """The last order - 1 tokens before a text, begin marks where the context is shorter."""
    toks = F.concat(F.array_repeat(F.lit(tx.BEGIN), order - 1), tx.tokens(F.coalesce(left_context, F.lit(""))))
    return F.array_join(F.slice(toks, F.size(toks) - order + 2, F.lit(order - 1)), "") if order > 1 else F.lit("")


def _spans(cases: DataFrame, longest: int) -> DataFrame:
    """case_id, i, j, span (array): every run of up to `longest` syllables."""
    at = cases.select("case_id", "readings", F.explode(F.expr("filter(sequence(1, size(readings)), j -> j <= size(readings) and j > 0)")).alias("j"))
    at = at.withColumn("i", F.explode(F.expr(f"sequence(greatest(0, j - {longest}), j - 1)")))
    return at.select("case_id", "i", "j", F.expr("slice(readings, i + 1, j - i)").alias("span"))


def arcs(cases: DataFrame, entries: DataFrame, longest: int, settings: Settings, alternatives: DataFrame | None = None) -> DataFrame:
    """case_id, i, j, word, log10_p, cost, edit (kind, position, observed, inferred; null for none) of what the lexicon
    (reading, rank, text, log10_p) has for each span: exact entries, then tone variants', then corrected ones."""
    known = entries.select("reading", F.col("rank").alias("entry_rank"), F.col("text").alias("word"), "log10_p")
    spans = _spans(cases, longest)
    edit_type = "struct<kind:string,position:int,observed:string,inferred:string>"
    key = lambda c: F.array_join(c, " ")
    exact = spans.withColumn("reading", key("span")).join(known, "reading").withColumn("turn", F.lit(0))
    out = exact
    if settings.tone_variants:
        swapped = spans.select("*", F.posexplode("span").alias("k", "r")).select("*", F.posexplode(ph.tone_variants("r")).alias("v", "x"))
        free = swapped.withColumn("reading", key(F.transform("span", lambda r, n: F.when(n == F.col("k"), F.col("x")).otherwise(r)))).join(known, "reading").withColumn("turn", 1 + 8 * F.col("k") + F.col("v"))
        out = exact.unionByName(free.select(*exact.columns))
        # A text counts once a span, where it comes first.
        out = out.withColumn("n", F.row_number().over(Window.partitionBy("case_id", "i", "j", "word").orderBy("turn", "entry_rank"))).filter("n = 1").drop("n")
    if settings.per_span is not None:
        out = out.withColumn("n", F.row_number().over(Window.partitionBy("case_id", "i", "j").orderBy("turn", "entry_rank", "word"))).filter(F.col("n") <= settings.per_span)
    out = out.select("case_id", "i", "j", "word", "log10_p", F.lit(0.0).alias("cost"), F.lit(None).cast(edit_type).alias("edit"))
    if alternatives is not None:
        some = alternatives.filter(F.col("rank") <= settings.edit_alternatives).select("observed", "inferred", "kind", F.col("cost").alias("edit_cost"))
        each = spans.select("*", F.posexplode("span").alias("k", "observed")).join(some, "observed")
        varied = each.withColumn("reading", key(F.transform("span", lambda r, n: F.when(n == F.col("k"), F.col("inferred")).otherwise(r)))).join(known.filter(F.col("entry_rank") <= settings.edit_entries), "reading")
        edit = F.struct("kind", (F.col("i") + F.col("k")).cast("int").alias("position"), "observed", "inferred").cast(edit_type)
        out = out.unionByName(varied.select("case_id", "i", "j", "word", "log10_p", F.col("edit_cost").alias("cost"), edit.alias("edit")))
    return out


def _scored(grown: DataFrame, model: Model, order: int) -> DataFrame:
    """`grown` (id, history, word and more) with corpus raised by the model's log10 chances of the word's characters."""
    each = grown.select("id", F.explode(F.expr(f"transform(sequence(0, length(word) - 1), k -> substring(concat(history, word), k + 1, {order}))")).alias("gram"))
    grams = each.select("gram").distinct().select("gram", *(F.expr(f"right(gram, {n})").alias(f"g{n}") for n in range(1, order + 1)))
    p = model(grams).select("gram", F.log10("p").alias("log_p"))
    sums = each.join(p, "gram").groupBy("id").agg(F.sum("log_p").alias("delta"))
    return grown.join(sums, "id").withColumn("corpus", F.col("corpus") + F.col("delta")).drop("delta")


def _total(s: Settings, has_model: bool) -> Column:
    corpus = s.corpus_weight * F.col("corpus") if has_model else F.lit(0.0)
    return corpus + s.lexical_weight * F.col("lexical") - s.cost_weight * F.col("cost")


def search(cases: DataFrame, entries: DataFrame, longest: int, model: Model | None = None, settings: Settings = Settings(), alternatives: DataFrame | None = None, guard: object | None = None) -> DataFrame:
    """case_id, p, n, text, total, corpus, lexical, cost, segments, edits, kept of every hypothesis of every position;
    kept: whether the beam took it on. Those with p = n are the complete ones, which no beam cuts.

    cases: case_id, readings and left_context (may be absent or null). Equal texts with equally many edits at one
    position are one, with the best total (then the cheapest, then of fewest segments).
    """
    cases = cases if "left_context" in cases.columns else cases.withColumn("left_context", F.lit(None).cast("string"))
    cases = written(cases.select("case_id", "readings", "left_context").filter("size(readings) > 0"), "cases")
    most = cases.agg(F.max(F.size("readings"))).first()[0] or 0
    links = written(arcs(cases, entries, longest, settings, alternatives), "arcs")
    edit_type = dict(links.dtypes)["edit"]
    start = cases.select("case_id", F.size("readings").alias("n"), F.lit(0).alias("p"), F.lit("").alias("text"), history("left_context", settings.order).alias("history"), *(F.lit(0.0).alias(c) for c in ("total", "corpus", "lexical", "cost")), F.lit(0).alias("segments"), F.array().cast(f"array<{edit_type}>").alias("edits"), F.lit(True).alias("kept"))
    layers = [start]
    by_total, by_lexical = (F.desc("total"), F.asc("text"), F.asc("cost")), (F.desc("lexical"), F.asc("text"), F.asc("cost"))
    for j in range(1, most + 1):
        before = reduce(DataFrame.unionByName, layers[-longest:]).filter("kept")
        grown = before.join(links.filter(F.col("j") == j).select("case_id", F.col("i").alias("p"), "word", "log10_p", F.col("cost").alias("arc_cost"), "edit"), ["case_id", "p"])
        grown = grown.filter(F.col("edit").isNull() | (F.size("edits") == 0))
        grown = grown.select("case_id", "n", F.lit(j).alias("p"), F.length("text").alias("start"), F.concat("text", "word").alias("text"), "history", "word", "corpus", (F.col("lexical") + F.col("log10_p")).alias("lexical"), (F.col("cost") + F.col("arc_cost")).alias("cost"), (F.col("segments") + 1).alias("segments"), F.when(F.col("edit").isNull(), F.col("edits")).otherwise(F.concat("edits", F.array("edit"))).alias("edits"))
        if guard is not None or model is not None:
            grown = written(grown.withColumn("id", F.monotonically_increasing_id()), "grown")
        if guard is not None:
            grown = grown.join(guard.violations(grown.select("id", "text", "start", F.lit(False).alias("final"))), "id", "left_anti")
        if model is not None:
            grown = _scored(grown, model, settings.order)
        grown = grown.withColumn("total", _total(settings, model is not None)).withColumn("history", F.expr(f"right(concat(history, word), {settings.order - 1})"))
        kept = ("history", "total", "corpus", "lexical", "cost", "segments", "edits")
        best = grown.groupBy("case_id", "n", "p", "text", F.size("edits").alias("n_edits")).agg(F.min_by(F.struct(*kept), F.struct(-F.col("total"), "cost", "segments", "history")).alias("b")).select("case_id", "n", "p", "text", "b.*")
        rank = F.row_number().over(Window.partitionBy("case_id").orderBy(*(by_lexical if settings.prune_by_lexical else by_total)))
        best = best.withColumn("rank", rank).withColumn("kept", F.col("rank") <= settings.beam)
        if settings.lexical_slots:
            spare = F.row_number().over(Window.partitionBy("case_id", "kept").orderBy(*by_lexical))
            best = best.withColumn("spare", spare).withColumn("kept", F.col("kept") | (F.col("spare") <= settings.lexical_slots)).drop("spare")
        layers.append(written(best.select(*start.columns), "beam"))
    out = reduce(DataFrame.unionByName, layers)
    if guard is not None:
        done = written(out.filter("p = n").withColumn("id", F.monotonically_increasing_id()), "complete")
        fit = done.join(guard.violations(done.select("id", "text", F.lit(0).alias("start"), F.lit(True).alias("final"))), "id", "left_anti").drop("id")
        out = out.filter("p < n").unionByName(fit)
    return out


def complete(states: DataFrame, nbest: int | None = None) -> DataFrame:
    """case_id, rank (from 1) and the rest of complete hypotheses, best totals first, then by text."""
    w = Window.partitionBy("case_id").orderBy(F.desc("total"), "text", "cost")
    out = states.filter("p = n").withColumn("rank", F.row_number().over(w))
    out = out if nbest is None else out.filter(F.col("rank") <= nbest)
    return out.select("case_id", "rank", "text", "total", "corpus", "lexical", "cost", "segments", "edits")


def decoded(cases: DataFrame, entries: DataFrame, longest: int, model: Model | None = None, settings: Settings = Settings(), alternatives: DataFrame | None = None, guard: object | None = None) -> DataFrame:
    return complete(search(cases, entries, longest, model, settings, alternatives, guard), settings.nbest)


def traced(states: DataFrame, gold: DataFrame) -> DataFrame:
    """case_id, first_lost, final_rank, complete: where a prefix of an acceptable text (gold: case_id, text) was made
    but not kept (null: nowhere), the rank of the first acceptable text among all complete ones (from 0; null: none),
    and how many there are."""
    prefixes = gold.select("case_id", F.posexplode(F.expr("transform(sequence(0, length(text)), k -> left(text, k))")).alias("p", "text")).distinct()
    hit = states.join(prefixes, ["case_id", "p", "text"], "left_semi").groupBy("case_id", "p").agg(F.max("kept").alias("kept"), F.first("n").alias("n"))
    lost = hit.filter("not kept and p < n").groupBy("case_id").agg(F.min("p").alias("first_lost"))
    ends = complete(states)
    ranks = ends.join(gold.select("case_id", "text").distinct(), ["case_id", "text"], "left_semi").groupBy("case_id").agg((F.min("rank") - 1).alias("final_rank"))
    counts = ends.groupBy("case_id").agg(F.count(F.lit(1)).alias("complete"))
    every = states.select("case_id").distinct()
    return every.join(lost, "case_id", "left").join(ranks, "case_id", "left").join(counts, "case_id", "left").select("case_id", "first_lost", "final_rank", F.coalesce("complete", F.lit(0)).alias("complete"))


def tolerant(cases: DataFrame, entries: DataFrame, longest: int, model: Model | None, alternatives: DataFrame, inventory: DataFrame, settings: Settings = Settings(), threshold: float = -4.0, most: int = 20, swap_cost: float = 2.0) -> DataFrame:
    """case_id, rank, text, total, cost, reason: exact candidates; where a case has none, or the best one's corpus score
    a syllable is below `threshold`, also those with one corrected syllable or two swapped tones, the best way for each
    text. reason: not_expanded, no_exact_candidate or low_exact_quality."""
    exact = written(decoded(cases, entries, longest, model, settings), "exact")
    best = exact.filter("rank = 1").select("case_id", F.col("corpus").alias("best"))
    why = F.when(F.col("best").isNull(), "no_exact_candidate")
    if model is not None:
        why = why.when(F.col("best") / F.size("readings") < threshold, "low_exact_quality")
    asked = written(cases.filter("size(readings) > 0").join(best, "case_id", "left").withColumn("reason", why.otherwise("not_expanded")).drop("best"), "asked")
    open_ = asked.filter("reason <> 'not_expanded'").drop("reason")
    pool = exact.select("case_id", "text", "total", "cost")
    edited = decoded(open_, entries, longest, model, settings, alternatives).filter("size(edits) > 0")
    pool = pool.unionByName(edited.select("case_id", "text", "total", "cost"))
    swaps = case_ops.tone_swaps(open_, inventory)
    varied = open_.join(swaps, "case_id").withColumns({"own": F.col("case_id"), "readings": F.transform("readings", lambda r, i: F.when(i == F.col("position"), F.col("first")).when(i == F.col("position") + 1, F.col("second")).otherwise(r)), "case_id": F.concat_ws("@", F.col("case_id").cast("string"), "position")})
    varied = written(varied.drop("position", "first", "second"), "swapped")
    three = decoded(varied, entries, longest, model, replace(settings, nbest=min(3, settings.nbest)))
    back = three.join(varied.select("case_id", "own"), "case_id").select(F.col("own").alias("case_id"), "text", (F.col("total") - settings.cost_weight * swap_cost).alias("total"), F.lit(swap_cost).alias("cost"))
    once = pool.unionByName(back).groupBy("case_id", "text").agg(F.min(F.struct((-F.col("total")).alias("s"), "cost")).alias("b")).select("case_id", "text", (-F.col("b.s")).alias("total"), "b.cost")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("total"), "cost", "text"))).filter(F.col("rank") <= most)
    return asked.select("case_id", "reason").join(ranked, "case_id", "left").select("case_id", "rank", "text", "total", "cost", "reason")


def generated(cases: DataFrame, entries: DataFrame, compositions: DataFrame, most: int = 8) -> DataFrame:
    """case_id, rank (from 0), text, score, kind: whole-reading entries and up to `most` texts of several segments
    (case_id, text, score, segments) that are no whole entry; by score, words first, then text."""
    words = cases.select("case_id", F.array_join("readings", " ").alias("reading")).join(entries.select("reading", "text", F.col("log10_p").alias("score")), "reading").select("case_id", "text", "score", F.lit("word").alias("kind"))
    more = compositions.filter("segments > 1").join(words.select("case_id", "text"), ["case_id", "text"], "left_anti")
    some = more.withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "segments", "text"))).filter(F.col("n") <= most).select("case_id", "text", "score", F.lit("composition").alias("kind"))
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), F.when(F.col("kind") == "word", 0).otherwise(1), "text")
    return words.unionByName(some).withColumn("rank", F.row_number().over(w) - 1)
