"""Readings of texts from evidence: longest known words first, then characters with one reading.

Texts meet the evidence tables by joins on their substrings and characters; what a text's positions found is then
folded from left to right inside one row. No table of words or readings is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions import text as tx

#: What an annotation may use: known words, and rated single characters' explicit reading.
POLICIES = {"unambiguous": (False, False), "known_word": (True, False), "bounded": (True, True)}


def char_evidence(char_readings: DataFrame, words: DataFrame) -> DataFrame:
    """char, options (distinct readings, sorted), single: the one explicit reading that rated words give the character."""
    options = char_readings.groupBy("char").agg(F.sort_array(F.collect_set("reading")).alias("options"))
    rated = words.filter("readings is not null and length(text) = 1").groupBy(F.col("text").alias("char")).agg(F.collect_set(F.element_at("readings", 1)).alias("r"))
    return options.join(rated, "char", "left").select("char", "options", F.when(F.size("r") == 1, F.element_at("r", 1)).alias("single"))


def word_evidence(words: DataFrame) -> DataFrame:
    """word, readings of words of two characters and more with exactly one explicit reading sequence."""
    some = words.filter("readings is not null and length(text) > 1").groupBy(F.col("text").alias("word")).agg(F.collect_set("readings").alias("r"))
    return some.filter(F.size("r") == 1).select("word", F.element_at("r", 1).alias("readings"))


def _characters(text: Column | str) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def readable(texts: DataFrame, chars: DataFrame, words: DataFrame, policy: str = "bounded") -> DataFrame:
    """`texts` (text and more) without those that `annotated` refuses for one character: one that stands in no word and
    has no reading of its own. What is left may still be refused. The other characters are one string, no longer than
    a script."""
    use_words, use_singles = POLICIES[policy]
    one = F.size("options") == 1
    own = chars.filter(one | F.coalesce(F.array_contains("options", F.col("single")), F.lit(False)) if use_singles else one).select("char")
    if use_words:
        own = own.union(words.select(F.explode(_characters("word"))))
    known = own.agg(F.array_join(F.collect_set("char"), ""))
    return texts.filter(F.call_function("translate", F.col("text"), known.scalar(), F.lit("")) == "")


def spots(texts: DataFrame, chars: DataFrame, words: DataFrame, longest: int, script: str = "han") -> DataFrame:
    """text, spots: for each position from 0 its character, whether it is of the script, options, single, and the
    longest known word that starts there."""
    once = texts.select("text").filter("text is not null").distinct()
    # A text's positions stay where it stands: characters are no more than a script has, and are broadcast.
    each = once.select("text", F.posexplode(_characters("text")).alias("i", "char")).join(F.broadcast(chars), "char", "left")
    listed = each.groupBy("text").agg(F.collect_list(F.struct("i", "char", tx.is_script("char", script).alias("fit"), "options", "single")).alias("each"))
    cut = once.select("text", F.expr(f"explode(flatten(transform(sequence(0, length(text)), i -> transform(sequence(2, {max(2, longest)}), n -> struct(i as i, n as n, substring(text, i + 1, n) as word)))))").alias("x")).select("text", "x.*").filter("length(word) = n")
    found = cut.join(words, "word").groupBy("text", "i").agg(F.max_by(F.struct("n", "readings"), "n").alias("word"))
    starts = found.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("i", "word"))).alias("at"))
    row = lambda x: F.struct(x["i"].alias("i"), x["char"].alias("char"), x["fit"].alias("fit"), x["options"].alias("options"), x["single"].alias("single"), F.try_element_at("at", x["i"]).alias("word"))
    return listed.join(starts, "text", "left").select("text", F.transform(F.array_sort("each"), row).alias("spots"))


def folded(spots_: Column | str, use_words: bool, use_singles: bool, checked: bool) -> Column:
    """(readings, reason, char): the reading sequence, or why and at which character there is none.

    checked: a character outside the script is a reason of its own."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("readings"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("char"))

    def step(s: Column, x: Column) -> Column:
        over = s["reason"].isNotNull() | (x["i"] < s["at"])
        word = x["word"].isNotNull() if use_words else F.lit(False)
        options = F.coalesce(x["options"], F.array().cast("array<string>"))
        one = F.when(F.size(options) == 1, F.element_at(options, 1))
        if use_singles:
            one = F.coalesce(one, F.when(F.array_contains(options, x["single"]), x["single"]))
        outside = ~x["fit"] if checked else F.lit(False)
        reason = F.when(outside, "outside_script").when(word | one.isNotNull(), F.lit(None).cast("string")).when(F.size(options) == 0, "no_reading").otherwise("ambiguous")
        added = F.when(reason.isNotNull(), F.array().cast("array<string>")).when(word, x["word"]["readings"]).otherwise(F.array(one))
        return F.when(over, s).otherwise(F.struct(
            F.when(word & reason.isNull(), x["i"] + x["word"]["n"]).otherwise(x["i"] + 1).alias("at"), F.concat(s["readings"], added).alias("readings"), reason.alias("reason"), F.when(reason.isNotNull(), x["char"]).alias("char"),
        ))

    done = F.aggregate(spots_, start, step)
    return F.struct(F.when(done["reason"].isNull(), done["readings"]).alias("readings"), done["reason"].alias("reason"), done["char"].alias("char"))


def annotated(texts: DataFrame, chars: DataFrame, words: DataFrame, longest: int, policy: str = "bounded", script: str = "han", checked: bool = True) -> DataFrame:
    """text, readings, reason, char of each distinct text; readings are null where there is a reason."""
    use_words, use_singles = POLICIES[policy]
    return spots(texts, chars, words, longest, script).select("text", folded("spots", use_words, use_singles, checked).alias("r")).select("text", "r.*")


def combined(texts: DataFrame, chars: DataFrame, words: DataFrame, longest: int, plane_readings: DataFrame, limit: int = 4, script: str = "han", checked: bool = False) -> DataFrame:
    """text, readings (array of sequences): the bounded one, or else all combinations of `plane_readings` (char,
    reading, in their `order`) where there are one to `limit`; null otherwise."""
    at = plane_readings.groupBy("char").agg(F.transform(F.array_sort(F.collect_set(F.struct("order", "reading"))), lambda x: x["reading"]).alias("plane"))
    plane = at.withColumn("plane", F.array_distinct("plane"))
    found = spots(texts, chars, words, longest, script)
    own = found.select("text", folded("spots", True, True, checked)["readings"].alias("one"))
    open_ = own.filter("one is null").select("text", F.posexplode(_characters("text")).alias("i", "char")).join(plane, "char", "left")
    listed = open_.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("plane", F.array().cast("array<string>")).alias("p")))), lambda x: x["p"]).alias("sets"))
    ways = F.aggregate("sets", F.lit(1).cast("double"), lambda a, s: a * F.size(s))
    every = F.aggregate("sets", F.array(F.array().cast("array<string>")), lambda a, s: F.flatten(F.transform(a, lambda x: F.transform(s, lambda r: F.concat(x, F.array(r))))))
    many = listed.withColumn("ways", ways).filter((F.col("ways") >= 1) & (F.col("ways") <= limit)).select("text", every.alias("many"))
    return own.join(many, "text", "left").select("text", F.coalesce(F.when(F.col("one").isNotNull(), F.array("one")), "many").alias("readings"))


def counted_words(texts: DataFrame, words: DataFrame, longest: int, script: str = "han") -> DataFrame:
    """word, c: greedy longest-match words of the script's characters, single characters where no word starts.

    words: (word). A text's positions are cut apart by the fold, and only then grouped."""
    keyed = texts.select(F.monotonically_increasing_id().alias("id"), tx.script_key("text", script).alias("text")).filter("text <> ''")
    once = keyed.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    cut = once.select("text", F.expr(f"explode(flatten(transform(sequence(0, length(text)), i -> transform(sequence(2, {max(2, longest)}), n -> struct(i as i, n as n, substring(text, i + 1, n) as word)))))").alias("x")).select("text", "x.*").filter("length(word) = n")
    found = cut.join(words.select("word").distinct(), "word", "left_semi").groupBy("text", "i").agg(F.max("n").alias("n"))
    starts = found.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("at"))
    met = once.join(starts, "text", "left")
    size = lambda i: F.coalesce(F.when(F.col("at").isNotNull(), F.try_element_at("at", i)), F.lit(1))
    none = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<i:int,n:int>>").alias("out"))
    step = lambda s, i: F.when(i < s["next"], s).otherwise(F.struct((i + size(i)).alias("next"), F.concat(s["out"], F.array(F.struct(i.alias("i"), size(i).alias("n")))).alias("out")))
    pieces = F.aggregate(F.expr("sequence(0, length(text) - 1)"), none, step, lambda s: s["out"])
    return met.select("text", "copies", F.explode(pieces).alias("p")).select(F.expr("substring(text, p.i + 1, p.n)").alias("word"), "copies").groupBy("word").agg(F.sum("copies").alias("c"))


def reading_issues(items: DataFrame, char_readings: DataFrame, script: str = "han") -> DataFrame:
    """item_id, issue, position of items (item_id, text, readings, acceptable): characters outside the script, unequal
    lengths, readings that the character does not have, and alternatives of other lengths."""
    issue = lambda name, at=-1, char=None, reading=None: F.struct(F.lit(name).alias("issue"), F.lit(at).alias("position") if isinstance(at, int) else at.alias("position"), (F.lit(None).cast("string") if char is None else char).alias("char"), (F.lit(None).cast("string") if reading is None else reading).alias("reading"))
    if_ = lambda condition, found: F.when(condition, found).otherwise(F.array().cast("array<struct<issue:string,position:int,char:string,reading:string>>"))
    even = F.length("text") == F.size("readings")
    each = F.transform(F.arrays_zip(_characters("text").alias("char"), F.col("readings").alias("reading")), lambda x, i: issue("reading", i, x["char"], x["reading"]))
    other = even & F.exists("acceptable", lambda a: F.length(a) != F.length("text"))
    found = F.concat(if_(~F.rlike("text", F.lit(f"^[{tx.SCRIPTS[script]}]+$")), F.array(issue("outside_script"))), if_(F.length("text") != F.size("readings"), F.array(issue("length"))), if_(even, each), if_(other, F.array(issue("alternative"))))
    # One pass over the items; characters' readings are no more than a script has, and are broadcast.
    known = F.broadcast(char_readings.select("char", "reading").distinct().withColumn("__known", F.lit(True)))
    met = items.select("item_id", F.explode(found).alias("x")).select("item_id", "x.*").join(known, ["char", "reading"], "left")
    return met.filter((F.col("issue") != "reading") | F.col("__known").isNull()).select("item_id", "issue", "position")


def differences(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """item_id, position, char, own, rule: where an item's readings are not those of its text's annotation."""
    met = items.join(annotations.filter("readings is not null").select("text", F.col("readings").alias("rule")), "text")
    each = met.filter("size(readings) = size(rule)").select("item_id", F.posexplode(F.arrays_zip(_characters("text").alias("char"), F.col("readings").alias("own"), F.col("rule").alias("rule"))).alias("position", "x"))
    return each.select("item_id", "position", "x.*").filter("own <> rule")
