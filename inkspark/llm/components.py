"""Connected components of a link table, by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.sources.shared import forget, written


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected(links: DataFrame) -> DataFrame:
    """node, root for every node of `links` (u, v): root is the least node that can be reached.

    Rounds work on linear-size tables and minima that combine before the shuffle; each round's links are a
    written table, so a lost executor repeats one round's tasks at most.
    """
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    seen = _digest(links)
    while seen[0]:
        # Large star: a node's larger neighbours go to the least of its neighbours and itself.
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        now = large.join(small, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now = written(now, "links")
        forget(links)
        links, before = now, seen
        seen = _digest(links)
        if seen == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())
