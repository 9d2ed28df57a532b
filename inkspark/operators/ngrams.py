"""N-gram tables and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.functions import text as tx


def counted(rows: DataFrame, order: int = 3, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, gram (tokens joined), c: the 1..order-grams that end at each token or at the end mark."""
    padded = rows.select(*by, tx.padded(tx.tokens(text), order).alias("t")) if by else rows.select(tx.padded(tx.tokens(text), order).alias("t"))
    at = padded.withColumn("i", F.explode(F.expr(f"sequence({order}, size(t))")))
    grams = F.array(*(F.struct(F.lit(n).alias("n"), F.array_join(F.slice("t", F.col("i") - n + 1, F.lit(n)), "").alias("gram")) for n in range(1, order + 1)))
    return at.select(*by, F.explode(grams).alias("g")).groupBy(*by, "g.n", "g.gram").agg(F.count(F.lit(1)).alias("c"))


def followers(counts: DataFrame) -> DataFrame:
    """history, total, types: how often and by how many tokens each history is followed, before any pruning."""
    return counts.filter("n > 1").groupBy(F.expr("left(gram, n - 1)").alias("history")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"))


def pruned(counts: DataFrame, least: int = 2, order: int = 3) -> DataFrame:
    return counts.filter((F.col("n") < order) | (F.col("c") >= least))


def continuation(counts: DataFrame) -> DataFrame:
    """n, gram, left_types: by how many tokens each (n-1)-gram is preceded."""
    return counts.filter("n > 1").groupBy((F.col("n") - 1).alias("n"), F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("left_types"))


def run_grams(rows: DataFrame, sizes: tuple[int, ...] = (1, 2, 3, 4), text: str = "text", script: str = "han", by: tuple[str, ...] = (), repeat: bool = False) -> DataFrame:
    """by, n, gram, c within maximal runs of the script.

    repeat: runs are words that come again and again, so they are counted first, and each is cut up once; where runs are
    clauses, that would only shuffle the corpus."""
    run = rows.select(*by, F.explode(tx.runs(text, script)).alias("run"))
    run = run.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("m")) if repeat else run.withColumn("m", F.lit(1))
    each = F.flatten(F.array(*(tx.grams("run", n) for n in sizes)))
    return run.select(*by, "m", F.explode(each).alias("gram")).groupBy(*by, F.length("gram").alias("n"), "gram").agg(F.sum("m").cast("long").alias("c"))


def pmi(grams: DataFrame, least: int = 5) -> DataFrame:
    """gram, c, pmi of grams of two characters up: the least log2 ratio over the two-part cuts."""
    total = grams.filter("n = 1").agg(F.sum("c").alias("total"))
    known = grams.select("gram", "c")
    cuts = grams.filter((F.col("n") > 1) & (F.col("c") >= least)).select("n", "gram", "c", F.explode(F.expr("sequence(1, n - 1)")).alias("k"))
    parts = cuts.select("*", F.expr("left(gram, k)").alias("l"), F.expr("substring(gram, k + 1)").alias("r"))
    met = parts.join(known.select(F.col("gram").alias("l"), F.col("c").alias("cl")), "l", "left").join(known.select(F.col("gram").alias("r"), F.col("c").alias("cr")), "r", "left").crossJoin(F.broadcast(total))
    ratio = F.log2(F.col("c") * F.col("total").cast("double") / (F.col("cl") * F.col("cr").cast("double")))
    return met.groupBy("n", "gram", "c").agg(F.min(F.coalesce(ratio, F.lit(float("-inf")))).alias("pmi"))


def extension_share(grams: DataFrame) -> DataFrame:
    """gram, c, share: the commonest extension by one character, as a share of the gram's own count."""
    sides = grams.filter("n > 1").select(F.explode(F.array(F.expr("left(gram, n - 1)"), F.expr("substring(gram, 2)"))).alias("gram"), "c")
    best = sides.groupBy("gram").agg(F.max("c").alias("best"))
    return grams.join(best, "gram", "left").select("n", "gram", "c", (F.coalesce("best", F.lit(0)) / F.col("c")).alias("share"))
