"""Cases of an evaluation: alternates, tone swaps, stages of loss, run summaries, groups and changed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions import phonetics
from inkspark.operators.metrics import linear_percentile


def loss_stage(reachable: str, final_rank: str, rank: str, top: int = 5) -> Column:
    """Where a case's target was lost; ranks from 0, null for absent."""
    lost = F.when(~F.col(reachable), "unreachable").when(F.col(final_rank).isNull(), "beam_pruned").when(F.col(rank).isNull(), "outside_output")
    return lost.when(F.col(rank) >= top, "generated_ranked_low").otherwise(f"top{top}")


def run_summary(rows: DataFrame, value: str, keys: tuple[str, ...] = (), digits: int = 3) -> DataFrame:
    """keys, n, mean, p50, p95, p99 of the values that are not null; null without values."""
    at = [F.round(linear_percentile(value, q), digits).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)]
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"), *at)


def alternates(text: str, replacements: tuple[tuple[str, str], ...], manual: str | None = None) -> Column:
    """The text, then every option so far with each replacement in turn, then manual ones; each once, first place."""
    options = F.array(F.col(text))
    for old, new in replacements:
        having = F.filter(options, lambda o: F.contains(o, F.lit(old)))  # noqa: B023
        options = F.concat(options, F.transform(having, lambda o: F.replace(o, F.lit(old), F.lit(new))))  # noqa: B023
    if manual:
        options = F.concat(options, F.filter(F.coalesce(manual, F.array().cast("array<string>")), lambda m: m != ""))
    return F.array_distinct(options)


def character_groups(groups: DataFrame, name: str = "group", characters: str = "characters") -> DataFrame:
    """ch, group of space-parted characters; one that stands twice is an error."""
    each = groups.select(F.explode(F.filter(F.split(characters, r"\s+"), lambda c: c != "")).alias("ch"), F.col(name).alias("group"))
    once = each.groupBy("ch").agg(F.min("group").alias("group"), F.count(F.lit(1)).alias("n"))
    return once.select("ch", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("in two groups: "), "ch"))).otherwise(F.col("group")).alias("group"))


def tone_swaps(cases: DataFrame, inventory: DataFrame, case: str = "case_id", readings: str = "readings") -> DataFrame:
    """case, position (from 0), first, second: neighbours with their tones swapped, where tones differ and both
    results are in `inventory` (syllable). Syllables that cannot be read have none."""
    pairs = cases.select(case, F.posexplode(F.arrays_zip(F.slice(readings, 1, F.greatest(F.size(readings) - 1, F.lit(0))).alias("a"), F.slice(readings, 2, F.greatest(F.size(readings) - 1, F.lit(0))).alias("b"))).alias("position", "at"))
    read = pairs.select(case, "position", phonetics.canonical("at.a").alias("a"), phonetics.canonical("at.b").alias("b"))
    body, tone = (lambda c: F.regexp_replace(c, "[ˊˇˋ˙]$", "")), (lambda c: F.regexp_extract(c, "([ˊˇˋ˙]?)$", 1))
    swapped = read.filter(tone(F.col("a")) != tone(F.col("b"))).select(case, "position", F.concat(body(F.col("a")), tone(F.col("b"))).alias("first"), F.concat(body(F.col("b")), tone(F.col("a"))).alias("second"))
    known = inventory.select("syllable").distinct()
    return swapped.join(known.withColumnRenamed("syllable", "first"), "first", "left_semi").join(known.withColumnRenamed("syllable", "second"), "second", "left_semi").select(case, "position", "first", "second")


def changed(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Rows of `child` that `parent` has not, repeats counted."""
    return child.select(*parent.columns).exceptAll(parent)
