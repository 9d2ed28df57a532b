"""Line dedup (operator 2): a deletion-neighbourhood join, in DataFrame functions only.

Two lines are the same when their words differ by at most one edit (a word put in, taken out or replaced);
lines of under `min_words` words are the same only when their words are equal: one edit of four words would leave them
less than 0.8 alike. A line goes if an earlier line, kept
or not, is the same; earlier is by (doc_id, line number). Every variant of a line with one word deleted is a hashed
key; lines with equal keys are joined with the key's earliest line, and the edit distance of that pair is verified.

The join is exact and never makes pairs within a group. One edit cannot touch both a line's first m and last m
words (m <= half), so variants are made only for lines that share such a block with another line, and only of the
words outside it. A variant at the same place of lines of one length means a replaced word, so the key's earliest
line serves all; a line equal to another's variant means an insertion, so shorter and longer lines are asked apart.

Defined cases: a null text stays null; lines without a word stay as they are and match nothing; an empty text
stays empty; repeated rows (one doc_id and text twice) get the same lines, as equal places are not earlier; a
document that loses all lines keeps its row with an empty text; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.llm.words import apart
from inkspark.sources.shared import forget, written

MIN_WORDS = 5
BLANK = " \t\n\x0b\x0c\r"
#: Bits of the sketch of lines that matter. It has this size for any input, and only saves shuffling: a false
#: positive goes to the exact join like any other line.
SKETCH_BITS = 1 << 24
PER_ROW = 32768  # bits in a row of Spark's bitmaps


def _words(line: Column | str) -> Column:
    return F.split(F.btrim(line, F.lit(BLANK)), r"[\x20\x09-\x0D]+")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, words, h, h2 of every line that has a word."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = cut.withColumn("line", F.btrim("line", F.lit(BLANK))).filter("line <> ''").select("doc_id", "text_key", "line_no", F.split("line", r"[\x20\x09-\x0D]+").alias("words"))
    return words.select("*", F.xxhash64("words").alias("h"), F.xxhash64(F.lit(1), "words").alias("h2"))


def _block_keys(min_words: int) -> Column:
    """Hashes of (m, side, the first or last m words) under which a line meets all lines within one edit.

    m is the largest power of two up to half of n: equal for n and n - 1 but where n is a power of two.
    """
    def pair(n: str) -> list[Column]:
        m = f"shiftleft(1, length(bin({n})) - 2)"
        return [F.expr(f"xxhash64('p', {m}, slice(words, 1, {m}))"), F.expr(f"xxhash64('s', {m}, slice(words, n - {m} + 1, {m}))")]

    own, shorter = F.array(*pair("n")), F.array(*pair("(n - 1)"))
    keys = F.when(F.expr("bin(n) rlike '^10*$'"), F.concat(own, shorter)).otherwise(own)
    return F.when(F.col("n") >= min_words, keys)


def _sketch(of: DataFrame, key: Column) -> DataFrame:
    """A bitmap of hashes, in SKETCH_BITS / PER_ROW rows at most."""
    bit = F.pmod(key, F.lit(SKETCH_BITS))
    return of.select(F.floor(bit / PER_ROW).alias("__bucket"), (bit % PER_ROW).alias("__bit")).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))


def _in_sketch(rows: DataFrame, key: Column, sketch: DataFrame) -> DataFrame:
    bit = F.pmod(key, F.lit(SKETCH_BITS))
    met = rows.withColumn("__bucket", F.floor(bit / PER_ROW)).join(F.broadcast(sketch), "__bucket")
    byte = F.conv(F.hex(F.substring("__bits", (bit % PER_ROW / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("__bucket", "__bits")


def _xor(a: Column | str) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def _running(a: Column) -> Column:
    return F.aggregate(a, F.array(F.lit(0).cast("long")), lambda x, y: F.concat(x, F.array(F.element_at(x, -1).bitwiseXOR(y))))


def _variants(members: DataFrame) -> DataFrame:
    """h, h2, first, ask, offer: keys of each variant of the words `rest` outside a member's block.

    same, fewer, more: whether the block has other lines of as many words, one word fewer, one more. Words are hashed
    with their places; explode() keeps what all variants of a line share from being computed for each.
    """
    hashed = lambda shift: F.transform("rest", lambda w, i: F.xxhash64(w, i - shift))
    key = lambda role, *parts: F.xxhash64("block", F.lit(role), *parts)
    keyed = lambda df, ask, offer, *parts: df.select("h", "h2", "first", key(ask, *parts).alias("ask"), key(offer, *parts).alias("offer"))
    own = members.withColumn("each", hashed(0)).withColumn("all", _xor("each"))
    replaced = own.filter("same").select("h", "h2", "first", "block", "n", "all", F.posexplode("each").alias("i", "v"))
    replaced = keyed(replaced, "same", "same", "n", "i", F.col("all").bitwiseXOR(F.col("v")))
    whole = keyed(own.filter("more"), "longer", "shorter", "n", "all")
    # Without word i: words before it keep their places, words after it move up by one.
    shifted = members.filter("fewer").withColumn("sums", F.arrays_zip(_running(hashed(0)).alias("before"), _running(hashed(1)).alias("after")))
    shifted = shifted.select("h", "h2", "first", "block", (F.col("n") - 1).alias("n"), F.element_at("sums", -1)["after"].alias("all"), F.posexplode(F.zip_with(F.expr("slice(sums, 1, size(sums) - 1)"), F.expr("slice(sums, 2, size(sums) - 1)"), lambda x, y: x["before"].bitwiseXOR(y["after"]))).alias("i", "v"))
    without = keyed(shifted, "shorter", "longer", "n", F.col("v").bitwiseXOR(F.col("all")))
    return replaced.union(whole).union(without)


def _verified(a: str, b: str) -> Column:
    """Whether the words differ by one edit at most."""
    gap = F.size(a) - F.size(b)
    differ = F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d)
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)  # 1-based; there is one as sizes differ
    longer = lambda x, y: F.slice(x, at + 1, F.size(x)) == F.slice(y, at, F.size(x))
    return F.when(gap == 0, F.size(differ) <= 1).when(gap == 1, longer(a, b)).when(gap == -1, longer(b, a)).otherwise(False)


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, line_no, near of every line that goes; near: for one that isn't equal to an earlier line."""
    docs = docs.select("doc_id", "text")
    keyed = _lines(docs).withColumn("n", F.size("words"))
    lines = written(keyed.select("doc_id", "text_key", "line_no", "h", "h2", "n", _block_keys(min_words).alias("blocks")), "lines")
    distinct = written(lines.groupBy("h", "h2", "n", "blocks").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("copies")), "line-firsts")

    blocks = distinct.select(F.explode("blocks").alias("block"), "h", "h2", "n")
    sizes = blocks.groupBy("block", "n").agg(F.count(F.lit(1)).alias("members"))
    shared = sizes.groupBy("block").agg(F.sum("members").alias("members"), F.collect_list(F.struct("n", "members")).alias("sizes")).filter("members > 1").select("block", "sizes")
    others = {"same": "x -> x.n = n and x.members > 1", "fewer": "x -> x.n = n - 1", "more": "x -> x.n = n + 1"}
    members = blocks.join(shared, "block").withColumns({k: F.expr(f"exists(sizes, {x})") for k, x in others.items()})
    members = written(members.filter("same or fewer or more").select("block", "h", "h2", *others), "line-blocks")

    # The members' words: only documents that hold a member's first place, and of them only those lines.
    places = distinct.select("h", "h2", "n", "first").join(members.select("h", "h2").distinct(), ["h", "h2"]).select("first", F.struct("h", "h2", "n").alias("line"))
    places = written(places.groupBy("first.doc_id").agg(F.collect_list(F.struct("first.line_no", "line")).alias("wanted")), "line-places")
    near_by = _in_sketch(docs, F.xxhash64("doc_id"), _sketch(places, F.xxhash64("doc_id")))
    asked = near_by.join(places.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id"))).withColumn("cut", F.split("text", "\n"))
    texts = asked.select("doc_id", F.inline(F.expr("transform(wanted, x -> struct(x.line_no, x.line, get(cut, x.line_no) as text))"))).withColumn("words", _words("text"))
    texts = texts.filter(F.xxhash64("words") == F.col("line.h")).select("line.*", F.struct("doc_id", "line_no").alias("first"), "words").dropDuplicates(["h", "h2"])
    texts = written(texts, "line-texts")

    tries = [F.struct(F.lit(side).alias("side"), m.alias("m")) for side in ("p", "s") for m in (F.expr("shiftleft(1, length(bin(n)) - 2)"), F.expr("shiftleft(1, length(bin(n - 1)) - 2)"))]
    cut = members.join(texts, ["h", "h2"]).withColumn("at", F.explode(F.array_distinct(F.array(*tries)))).select("*", "at.side", "at.m").filter(
        F.col("block") == F.when(F.col("side") == "p", F.expr("xxhash64('p', m, slice(words, 1, m))")).otherwise(F.expr("xxhash64('s', m, slice(words, n - m + 1, m))"))
    )
    rest = F.when(F.col("side") == "p", F.expr("slice(words, m + 1, n - m)")).otherwise(F.expr("slice(words, 1, n - m)"))
    variants = written(_variants(cut.withColumn("rest", rest).select("h", "h2", "first", "block", "n", "rest", *others)), "line-variants")
    offers = variants.groupBy(F.col("offer").alias("ask")).agg(F.min("first").alias("partner"))
    pairs = variants.drop("offer").join(offers, "ask").filter("partner < first").select("h", "h2", "partner").distinct()
    named = texts.select("h", "h2", F.col("words").alias("a"))
    other = texts.select(F.col("first").alias("partner"), F.col("words").alias("b"))
    near = pairs.join(named, ["h", "h2"]).join(other, "partner").filter(_verified("a", "b")).select("h", "h2").distinct().withColumn("near", F.lit(True))

    matter = distinct.select("h", "h2", "first", "copies").join(near, ["h", "h2"], "left").filter("copies > 1 or near")
    matter = written(matter, "line-drops")
    for done in (members, places, texts, variants):
        forget(done)
    met = _in_sketch(lines.select("doc_id", "text_key", "line_no", "h", "h2"), F.col("h"), _sketch(matter, F.col("h"))).join(matter, ["h", "h2"])
    later = ~F.col("first").eqNullSafe(F.struct("doc_id", "line_no"))
    return met.filter(later | F.coalesce("near", F.lit(False))).select("doc_id", "text_key", "line_no", (~later).alias("near"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with their columns, text without the lines that go, and three last columns: the counts of its lines with
    a word, of those that go, and of those among them that no earlier line equals."""
    i, k, gone, near = apart(docs, "id", "key", "drops", "nears")
    drops = dropped_lines(docs, min_words).groupBy(F.col("doc_id").alias(i), F.col("text_key").alias(k)).agg(
        F.collect_set("line_no").alias(gone), F.count_distinct(F.when(F.col("near"), F.col("line_no"))).alias(near)
    )
    met = docs.join(drops, docs["doc_id"].eqNullSafe(drops[i]) & (F.xxhash64(docs["text"]) == drops[k]), "left")
    left = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda line, n: ~F.array_contains(drops[gone], n)), "\n")
    n_lines = F.size(F.filter(F.split(docs["text"], "\n"), lambda line: F.btrim(line, F.lit(BLANK)) != ""))
    columns = [F.when(drops[gone].isNull(), docs["text"]).otherwise(left).alias("text") if c == "text" else docs[c] for c in docs.columns]
    counts = [F.when(docs["text"].isNull(), 0).otherwise(n_lines), F.when(drops[gone].isNull(), 0).otherwise(F.size(drops[gone])), F.coalesce(drops[near], F.lit(0))]
    return met.select(*columns, *(c.cast("long").alias(n) for c, n in zip(counts, apart(docs, "lines", "lost", "near"), strict=True)))
