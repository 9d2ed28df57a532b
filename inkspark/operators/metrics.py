"""Summaries of rankings, paired tests and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_percentile(value: str, q: float) -> Column:
    """Interpolated between the neighbours of (n - 1) q; null without values."""
    return F.percentile(value, F.lit(q))


def nearest(rows: DataFrame, value: str, shares: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and p<share>: the values at ranks (n - 1) q, rounded half to even; null without values.

    Ranks come from counts of distinct values: a group's values are never listed."""
    from pyspark.sql.window import Window

    sizes = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__m"))
    up = Window.partitionBy(*keys).orderBy("__v")
    upto = sizes.withColumn("__upto", F.sum("__m").over(up)).withColumn("__all", F.sum("__m").over(Window.partitionBy(*keys)))
    at = [F.min(F.when(F.col("__upto") > F.bround(F.lit(q) * (F.col("__all") - 1)), F.col("__v"))).alias(f"p{round(100 * q)}") for q in shares]
    return upto.groupBy(*keys).agg(*at)


def weight_summary(rows: DataFrame, weight: str) -> DataFrame:
    """min, p25, median, p75, max by nearest rank."""
    return nearest(rows, weight, (0.0, 0.25, 0.5, 0.75, 1.0)).select(F.col("p0").alias("min"), "p25", F.col("p50").alias("median"), "p75", F.col("p100").alias("max"))


def summary(outcomes: DataFrame, rank: str, base: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, top1, mrr, recall at 3, 5, 10, improved, worse, same; ranks from 1, null for absent."""
    hit = lambda k: F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}")
    at, was = F.coalesce(rank, F.lit(2**31)), F.coalesce(base, F.lit(2**31))
    return outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), hit(1).alias("top1"), F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))).alias("mrr"), hit(3), hit(5), hit(10), F.count_if(at < was).alias("improved"), F.count_if(at > was).alias("worse"), F.count_if(at == was).alias("same"))


def paired(rows: DataFrame, before: str, after: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, gained, lost and p, the exact two-sided binomial chance of as uneven a split."""
    out = rows.groupBy(*keys).agg(F.count_if(~F.col(before) & F.col(after)).alias("gained"), F.count_if(F.col(before) & ~F.col(after)).alias("lost"))
    n, k = F.col("gained") + F.col("lost"), F.least("gained", "lost")
    step = lambda a, i: F.struct((a["t"] + F.ln(n - i + 1) - F.ln(i)).alias("t"), (a["s"] + F.exp(a["t"] + F.ln(n - i + 1) - F.ln(i) - n * F.lit(0.6931471805599453))).alias("s"))
    first = F.struct(F.lit(0.0).alias("t"), F.exp(-n * F.lit(0.6931471805599453)).alias("s"))
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), first, step, lambda a: a["s"])
    return out.withColumn("p", F.least(F.lit(1.0), 2 * tail))


def selected(configs: DataFrame, gates: Column, primary: str, ties: tuple[Column, ...], width: float = 1 / 300 + 1e-9) -> DataFrame:
    """The one configuration that passes the gates, is within `width` of the best, and comes first by `ties`."""
    fit = configs.filter(gates)
    best = fit.agg(F.max(primary).alias("__best"))
    near = fit.crossJoin(F.broadcast(best)).filter(F.col(primary) >= F.col("__best") - width).drop("__best")
    return near.orderBy(*ties).limit(1)
