"""Lexicons: assembly from readings and rated words, priors and filters of derived words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkspark.sources.shared import written

#: Weights of tiers and character planes, and the derived words' weights.
TIERS = {5: 1000.0, 4: 200.0, 3: 50.0, 2: 10.0, 1: 3.0}
PLANES = {1: 1.0, 2: 0.1}
MEDIAN, LEAST, MOST, FRAGMENT = 10.0, 3.0, 200.0, 0.9


def _weights(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), key)


def resolved(words: DataFrame, char_readings: DataFrame) -> DataFrame:
    """`words` (text, tier, readings) with readings where every character has exactly one."""
    chars = words.filter("readings is null").select("text", "tier", F.posexplode(F.expr("filter(split(text, ''), c -> c <> '')")).alias("i", "char"))
    one = char_readings.groupBy("char").agg(F.count_distinct("reading").alias("n"), F.min("reading").alias("reading")).filter("n = 1")
    met = chars.join(one, "char").groupBy("text", "tier").agg(F.array_sort(F.collect_list(F.struct("i", "reading"))).alias("r")).filter(F.size("r") == F.length("text"))
    return words.filter("readings is not null").select("text", "tier", "readings").unionByName(met.select("text", "tier", F.transform("r", lambda x: x["reading"]).alias("readings")))


def assembled(words: DataFrame, char_readings: DataFrame) -> DataFrame:
    """text, reading (joined), frequency: single characters by plane, replaced by rated words of the same text and reading."""
    single = char_readings.select(F.col("char").alias("text"), "reading", _weights(PLANES, F.split_part("cns_code", F.lit("-"), F.lit(1)).cast("int")).alias("w")).groupBy("text", "reading").agg(F.max("w").alias("plane_weight")).filter("plane_weight is not null")
    rated = resolved(words, char_readings).select("text", F.array_join("readings", " ").alias("reading"), _weights(TIERS, F.col("tier")).alias("tier_weight"))
    met = single.join(rated, ["text", "reading"], "full_outer")
    return met.select("text", "reading", F.coalesce("tier_weight", "plane_weight").alias("frequency"))


def assembly_errors(words: DataFrame, char_readings: DataFrame) -> DataFrame:
    """line, text, error of rated words (text, tier, readings, line) that cannot enter the lexicon: a tier without a
    weight, a character without readings, as many readings as there are not characters, a reading that a character has
    not, several readings where none is given, and a word that stands twice (but for its first line)."""
    chars = char_readings.groupBy("char").agg(F.collect_set("reading").alias("known"))
    each = words.select("line", "text", "tier", "readings", F.posexplode(F.expr("filter(split(text, ''), c -> c <> '')")).alias("i", "char")).join(chars, "char", "left")
    own = F.get("readings", F.col("i"))
    per = each.groupBy("line", "text", "tier", "readings").agg(F.bool_or(F.col("known").isNull()).alias("unread"), F.bool_or(~F.array_contains("known", own)).alias("foreign"), F.bool_or(F.size("known") > 1).alias("open"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.element_at("known", 1).alias("r")))), lambda x: x["r"]), " ").alias("only"))
    given = F.col("readings").isNotNull()
    error = F.when(_weights(TIERS, F.col("tier")).isNull(), "tier").when(F.col("unread"), "no_reading").when(given & (F.size("readings") != F.length("text")), "length").when(given & F.col("foreign"), "reading").when(~given & F.col("open"), "ambiguous")
    judged = per.withColumn("error", error).withColumn("reading", F.when(given, F.array_join("readings", " ")).otherwise(F.col("only")))
    first = judged.filter("error is null").groupBy("text", "reading").agg(F.min("line").alias("first"))
    met = judged.join(first, ["text", "reading"], "left")
    return met.select("line", "text", F.coalesce("error", F.when(F.col("line") > F.col("first"), "repeated")).alias("error")).filter("error is not null")


def repeated(entries: DataFrame) -> DataFrame:
    """text, reading of entries that stand twice: an index refuses them."""
    return entries.groupBy("text", "reading").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("text", "reading")


def snapshot(entries: DataFrame) -> DataFrame:
    """Entries in the order of their index: reading, falling frequency, text."""
    return entries.orderBy("reading", F.desc("frequency"), "text")


def indexed(entries: DataFrame) -> DataFrame:
    """`entries` with rank among those of its reading (frequency falling, then text) and log10 of its share of all."""
    w = Window.partitionBy("reading").orderBy(F.desc("frequency"), "text")
    total = entries.agg(F.sum("frequency").alias("mass"))
    return entries.withColumn("rank", F.row_number().over(w)).crossJoin(F.broadcast(total)).withColumn("log10_p", F.log10(F.col("frequency") / F.col("mass"))).drop("mass")


def ratio_prior(rows: DataFrame, value: str) -> DataFrame:
    """`rows` with weight: the median is MEDIAN, in proportion, between LEAST and MOST; LEAST without any."""
    median = rows.filter(F.col(value) > 0).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    scaled = F.least(F.greatest(MEDIAN * F.col(value) / F.col("median"), F.lit(LEAST)), F.lit(MOST))
    return rows.crossJoin(F.broadcast(median)).withColumn("weight", F.when(F.col(value) > 0, scaled).otherwise(LEAST)).drop("median")


def log_prior(rows: DataFrame, value: str) -> DataFrame:
    median = rows.filter(F.col(value) > 0).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    scaled = F.least(F.greatest(MEDIAN * (1 + F.log10(F.col(value) / F.col("median"))), F.lit(LEAST)), F.lit(MOST))
    return rows.crossJoin(F.broadcast(median)).withColumn("weight", F.when(F.col(value) > 0, scaled).otherwise(LEAST)).drop("median")


def numbered(rows: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """`rows` with their numbers from 1 in a total order, without sorting all of them in one task: a written,
    range-partitioned table numbers its own partitions, and the partitions' sizes are added up."""
    part = F.shiftright("__at", 33)
    sorted_ = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("m"))
    before = sizes.select("__part", F.coalesce(F.sum("m").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return sorted_.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__before")


def bucket_prior(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Weights by rank share (value falling, then key): a tenth 50, three tenths 20, seven tenths 10, the rest 3."""
    total = rows.agg(F.count(F.lit(1)).alias("__all"))
    share = F.col("number") / F.col("__all") - 1e-12
    ranked = numbered(rows, F.desc(value), F.asc(key)).crossJoin(F.broadcast(total))
    return ranked.withColumn("weight", F.when(share <= 0.1, 50.0).when(share <= 0.3, 20.0).when(share <= 0.7, 10.0).otherwise(3.0)).drop("number", "__all")


def concentration(rows: DataFrame, key: str, domain: str, count: str) -> DataFrame:
    """key, domain, share: where a gram's rate (its count over the domain's) is largest, as a share of its rates."""
    totals = rows.groupBy(domain).agg(F.sum(count).alias("total"))
    rate = rows.join(totals, domain).withColumn("rate", F.col(count) / F.col("total"))
    best = rate.groupBy(key).agg(F.max(F.struct("rate")).alias("top"), F.sum("rate").alias("sum"))
    return rate.join(best, key).filter(F.col("rate") == F.col("top.rate")).groupBy(key).agg(F.min(domain).alias(domain), F.first(F.col("rate") / F.col("sum")).alias("share"))


def rejection(per_million: float = 2.0) -> Column:
    """Why a derived word is left out (null: it stays), over pooled, total, docs and share columns."""
    return F.when(F.col("pooled") * 1e6 < per_million * F.col("total"), "rare").when(F.col("docs") < 2, "one_document").when(F.col("share") >= FRAGMENT, "fragment")
