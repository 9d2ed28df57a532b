"""Reading-to-text decoding: all cases advance one end position at a time, as joins and window limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkspark.sources.shared import written


def spans(cases: DataFrame, longest: int) -> DataFrame:
    """case_id, n, i, j, reading: every run of up to `longest` syllables."""
    at = cases.select("case_id", "readings", F.size("readings").alias("n"), F.explode(F.sequence(F.lit(1), F.size("readings"))).alias("j"))
    at = at.withColumn("i", F.explode(F.expr(f"sequence(greatest(0, j - {longest}), j - 1)")))
    return at.select("case_id", "n", "i", "j", F.expr("array_join(slice(readings, i + 1, j - i), ' ')").alias("reading"))


def _longest_case(cases: DataFrame) -> int:
    """Syllables of the longest case."""
    return cases.agg(F.max(F.size("readings"))).first()[0] or 0


def decoded(cases: DataFrame, entries: DataFrame, longest: int, beam: int = 10, per_span: int = 5) -> DataFrame:
    """case_id, rank, text, score, segments: k-best texts under the entries' log10_p (columns reading, rank, text).

    Equal texts keep the best score, then the fewest segments. Each position's hypotheses are a written table, which
    later positions read: the plan of one does not grow with the positions before it.
    """
    arcs = written(spans(cases, longest).join(entries.filter(F.col("rank") <= per_span).select("reading", F.col("text").alias("word"), "log10_p"), "reading").select("case_id", "i", "j", "word", "log10_p"), "arcs")
    states = [cases.select("case_id", F.size("readings").alias("n"), F.lit(0).alias("p"), F.lit("").alias("text"), F.lit(0.0).alias("score"), F.lit(0).alias("segments"))]
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    for j in range(1, _longest_case(cases) + 1):
        grown = union(states[-longest:]).join(arcs.filter(F.col("j") == j).select("case_id", F.col("i").alias("p"), "word", "log10_p"), ["case_id", "p"])
        now = grown.select("case_id", "n", F.lit(j).alias("p"), F.concat("text", "word").alias("text"), (F.col("score") + F.col("log10_p")).alias("score"), (F.col("segments") + 1).alias("segments"))
        once = now.groupBy("case_id", "n", "p", "text").agg(F.min(F.struct((-F.col("score")).alias("s"), "segments")).alias("b")).select("case_id", "n", "p", "text", (-F.col("b.s")).alias("score"), "b.segments")
        w = Window.partitionBy("case_id").orderBy(F.desc("score"), "segments", "text")
        states.append(written(once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= beam).drop("rank"), "beam"))
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "segments", "text")
    return union(states).filter("p = n").withColumn("rank", F.row_number().over(w)).select("case_id", "rank", "text", "score", "segments")


def reachable(cases: DataFrame, entries: DataFrame, longest: int) -> DataFrame:
    """case_id, reachable: whether some sequence of entries covers all syllables, from one fold over a case's arcs."""
    arcs = spans(cases, longest).join(entries.select("reading").distinct(), "reading", "left_semi")
    known = arcs.groupBy("case_id").agg(F.array_sort(F.collect_set(F.struct("j", "i"))).alias("arcs"))
    step = lambda a, x: F.when(F.array_contains(a, x["i"]) & ~F.array_contains(a, x["j"]), F.concat(a, F.array(x["j"]))).otherwise(a)
    ends = known.select("case_id", F.aggregate("arcs", F.array(F.lit(0)), step).alias("all"))
    return cases.join(ends, "case_id", "left").select("case_id", F.array_contains(F.coalesce("all", F.array(F.lit(0))), F.size("readings")).alias("reachable"))


def weighed(corpus: str = "corpus", lexical: str = "lexical", cost: str = "cost", corpus_weight: float = 1.0, lexical_weight: float = 1.0, cost_weight: float = 1.0):
    """The linear score; a null corpus score counts as nothing."""
    return corpus_weight * F.coalesce(corpus, F.lit(0.0)) + lexical_weight * F.col(lexical) - cost_weight * F.col(cost)
