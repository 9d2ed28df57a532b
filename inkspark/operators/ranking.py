"""Ranking, mixing and confidence of candidates within a case."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(rows: DataFrame, case: str, score: str, base: str) -> DataFrame:
    """`rows` with rank: scored ones by falling score (ties by base position), the others after them in base order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy(F.desc_nulls_last(score), base)))


def share10(rows: DataFrame, case: str, score: str, name: str = "share") -> DataFrame:
    """10 ** score as shares of the case."""
    w = Window.partitionBy(case)
    raised = F.pow(F.lit(10.0), F.col(score) - F.max(score).over(w))
    return rows.withColumn("__r", raised).withColumn(name, F.col("__r") / F.sum("__r").over(w)).drop("__r")


def mixed(rows: DataFrame, case: str, score: str, contextual: str, weight: Column | float, base: str) -> DataFrame:
    """`rows` with mixed and rank: (1 - w) of the scores' shares and w of the contextual chances (0 for none)."""
    w = F.lit(weight) if isinstance(weight, int | float) else weight
    out = share10(rows, case, score).withColumn("mixed", (1 - w) * F.col("share") + w * F.coalesce(contextual, F.lit(0.0)))
    return ordered(out, case, "mixed", base)


def confidence(rows: DataFrame, case: str, p: str, most: float = 0.6, margin: Sequence[float] = (0.05, 0.30), entropy: Sequence[float] = (0.70, 0.95), least: float = 0.5, disagreement: str | None = None, instability: str | None = None, high: Sequence[float] = (0.5, 0.5)) -> DataFrame:
    """case, margin, entropy (of ln, over ln of the number), gate, weight, confident; a case of one has no gate.

    disagreement, instability: columns that are one value a case (null: not measured) and close the gate towards
    `high`. The two largest chances come from one pass over a case's distinct ones: chances that are computed twice may
    differ in their last digit, and the largest would then stand below itself."""
    ramp = lambda x, a: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - a[0]) / (a[1] - a[0])))
    signals = [F.max(c).alias(f"__{i}") for i, c in enumerate((disagreement, instability)) if c]
    per = rows.groupBy(case, p).agg(F.count(F.lit(1)).alias("__m"), *signals).withColumn("__at", F.row_number().over(Window.partitionBy(case).orderBy(F.desc_nulls_last(p))))
    place = lambda i, c: F.max(F.when(F.col("__at") == i, F.col(c)))
    out = per.groupBy(case).agg(F.sum(F.when(F.col(p).isNotNull(), F.col("__m"))).alias("n"), F.sum(F.when(F.col(p) > 0, -F.col(p) * F.ln(p) * F.col("__m")).otherwise(0.0)).alias("h"), place(1, p).alias("first"), place(1, "__m").alias("firsts"), place(2, p).alias("second"), *(F.max(f"__{i}").alias(f"__{i}") for i, c in enumerate((disagreement, instability)) if c))
    out = out.withColumn("second", F.when(F.col("firsts") > 1, F.col("first")).otherwise(F.col("second")))
    out = out.withColumns({"margin": F.when(F.col("n") > 1, F.col("first") - F.col("second")).otherwise(0.0), "entropy": F.when(F.col("n") > 1, F.col("h") / F.ln("n")).otherwise(0.0)})
    gate = ramp(F.col("margin"), margin) * (1 - ramp(F.col("entropy"), entropy))
    for i, c in enumerate((disagreement, instability)):
        if c:
            gate = gate * F.coalesce(1 - ramp(F.col(f"__{i}"), (0.0, high[i])), F.lit(1.0))
    return out.withColumn("gate", F.when(F.col("n") > 1, gate).otherwise(0.0)).select(case, "margin", "entropy", "gate", (most * F.col("gate")).alias("weight"), (F.col("gate") >= least).alias("confident"))


def preferences(rows: DataFrame, case: str, option: str, judged: str) -> DataFrame:
    """case, a, b, f: both orders of each pair of a case's few options, made even: (f(a, b) + 1 - f(b, a)) / 2."""
    a, b = rows.select(case, F.col(option).alias("a"), F.col(judged).alias("x")), rows.select(case, F.col(option).alias("b"), F.col(judged).alias("y"))
    return a.join(b, case).filter("a <> b").select(case, "a", "b", (F.col("x") / (F.col("x") + F.col("y"))).alias("f"))


def mean_wins(prefs: DataFrame, case: str) -> DataFrame:
    wins = prefs.groupBy(case, "a").agg(F.avg("f").alias("win"))
    return wins.withColumn("p", F.col("win") / F.sum("win").over(Window.partitionBy(case))).select(case, F.col("a").alias("option"), "p")


def bradley_terry(prefs: DataFrame, case: str, prior: float = 0.1, rounds: int = 200) -> DataFrame:
    """case, option, p: strengths by the minorise-maximise rule with a prior win on either side of each pair."""
    kind = dict(prefs.dtypes)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.pivot(index="a", columns="b", values="f").sort_index().sort_index(axis=1)
        wins = (f + prior).sum(axis=1).to_numpy()
        apart = ~f.isna().to_numpy()
        s = wins * 0 + 1 / len(wins)
        for _ in range(rounds):
            s = wins / ((1 + 2 * prior) / (s[:, None] + s[None, :]) * apart).sum(axis=1)
            s = s / s.sum()
        return pd.DataFrame({case: frame[case].iloc[0], "option": f.index, "p": s})

    return prefs.groupBy(case).applyInPandas(solve, f"{case} {kind[case]}, option {kind['a']}, p double")


def judged_contextual(rows: DataFrame, case: str, p: str, tolerance: float = 1e-3) -> DataFrame:
    """case, status: ok where every chance is in [0, 1] and they sum to 1, fallback with its reason otherwise."""
    sums = rows.groupBy(case).agg(F.count_if(F.col(p).isNull() | F.isnan(p)).alias("missing"), F.count_if(~F.col(p).between(0, 1)).alias("outside"), F.sum(p).alias("total"))
    reason = F.when(F.col("missing") > 0, "missing").when(F.col("outside") > 0, "out_of_range").when(F.abs(F.col("total") - 1) > tolerance, "sum")
    return sums.select(case, F.when(reason.isNull(), "ok").otherwise("fallback").alias("status"), reason.alias("reason"))


def baseline(rows: DataFrame, case: str, score: str, base: str) -> DataFrame:
    """`rows` in the order they came: score and rank as they are."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy(base))).withColumn("mixed", F.col(score))


def contract_breaches(rows: DataFrame, case: str, text: str, base: str) -> DataFrame:
    """case, breach of cases whose base positions are not 0, 1, 2 .. or whose texts repeat."""
    n = rows.groupBy(case).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(text).alias("t"), F.count_distinct(base).alias("b"), F.min(base).alias("low"), F.max(base).alias("high"))
    breach = F.when((F.col("b") != F.col("n")) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1), "positions").when(F.col("t") != F.col("n"), "repeated_text")
    return n.select(case, breach.alias("breach")).filter("breach is not null")


def by_frequency(rows: DataFrame, case: str, frequency: str, base: str) -> DataFrame:
    return ordered(rows, case, frequency, base)


def by_corpus(rows: DataFrame, case: str, log10_p: str, score: str, base: str, weight: float = 0.0) -> DataFrame:
    """`rows` with mixed, the corpus score and `weight` of the baseline's, and rank by it."""
    return ordered(rows.withColumn("mixed", F.col(log10_p) + weight * F.col(score)), case, "mixed", base)


def window(rows: DataFrame, families: DataFrame, case: str, top: int = 12) -> DataFrame:
    """case, family, representative, rank of the first `top` families of each case: what a backend is asked about."""
    return families.filter(F.col("rank") < top).select(case, "family", F.col("representative").alias("option"), "rank")


def shortened(context: Column | str, most: int = 64) -> Column:
    """The end of a context, at most `most` characters."""
    return F.right(F.coalesce(context, F.lit("")), F.lit(most)) if most else F.lit("")


def answers_judged(asked: DataFrame, answered: DataFrame, case: str, tolerance: float = 1e-3) -> DataFrame:
    """case, status, reason of each asked case: ok, or fallback where the answer is late or missing, empty, has options
    that were not asked, lacks some, or has chances outside [0, 1] or of another sum. Cases of one option are ok.

    asked: case, option; answered: case, option, p, error (null: none; else its reason)."""
    size = asked.groupBy(case).agg(F.count(F.lit(1)).alias("n"))
    got = answered.join(asked.select(case, "option", F.lit(True).alias("known")), [case, "option"], "left")
    bad = F.col("p").isNull() | F.isnan("p") | ~F.col("p").between(0, 1)
    some = F.col("option").isNotNull()
    sums = got.groupBy(case).agg(F.max("error").alias("error"), F.count("option").alias("m"), F.count_if(some & F.col("known").isNull()).alias("unknown"), F.count_if(F.col("known") & bad).alias("bad"), F.count_if(F.col("known")).alias("hit"), F.sum(F.when(F.col("known") & ~bad, F.col("p"))).alias("total"))
    met = size.join(sums, case, "left")
    reason = F.when(F.col("n") < 2, F.lit(None).cast("string")).when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce("m", F.lit(0)) == 0, "empty_response").when(F.col("unknown") > 0, "unknown_candidate").when(F.col("hit") < F.col("n"), "invalid_probability").when((F.col("bad") > 0) | (F.abs(F.col("total") - 1) > tolerance), "invalid_probability")
    return met.select(case, F.when(reason.isNull(), "ok").otherwise("fallback").alias("status"), reason.alias("reason"))


def contextual(rows: DataFrame, families: DataFrame, answered: DataFrame, case: str, text: str, score: str, base: str, top: int = 12, tolerance: float = 1e-3) -> DataFrame:
    """`rows` with p (their family's chance), rank, status and reason: families of the window by falling chance, the
    others after them in base order; a case whose answer is refused, and one of a single family, stays as it came.

    families: case, family, representative, members, rank."""
    asked = window(rows, families, case, top)
    judged = answers_judged(asked, answered, case, tolerance)
    chances = asked.join(answered.select(case, "option", "p"), [case, "option"]).join(judged.filter("status = 'ok'").select(case), case, "left_semi")
    single = asked.groupBy(case).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(case)
    chances = chances.join(single, case, "left_anti").select(case, "family", "p")
    members = families.select(case, "family", F.explode("members").alias(text))
    met = rows.join(members, [case, text], "left").join(chances, [case, "family"], "left").join(judged, case, "left")
    return ordered(met, case, "p", base).drop("family")


def hybrid(rows: DataFrame, case: str, score: str, p: str, status: str, weight: Column | float, base: str) -> DataFrame:
    """`mixed` where the contextual ranking is ok, exactly the base order where it fell back or the weight is 0."""
    w = F.lit(float(weight)) if isinstance(weight, int | float) else weight
    out = mixed(rows, case, score, p, w, base)
    asis = (F.col(status) != "ok") | (w == 0)
    place = F.row_number().over(Window.partitionBy(case).orderBy(base))
    return out.withColumn("__place", place).withColumn("rank", F.when(asis, F.col("__place")).otherwise(F.col("rank"))).drop("__place")


def disagreement(rows: DataFrame, case: str, option: str, judged: str) -> DataFrame:
    """case, disagreement: the mean gap between the two orders of each pair, f(a, b) and 1 - f(b, a); judged: f of each
    ordered pair (option, other)."""
    a = rows.select(case, F.col(option).alias("a"), F.col("other").alias("b"), F.col(judged).alias("x"))
    b = rows.select(case, F.col(option).alias("b"), F.col("other").alias("a"), F.col(judged).alias("y"))
    return a.join(b, [case, "a", "b"]).filter("a < b").groupBy(case).agg(F.round(F.avg(F.abs(F.col("x") - (1 - F.col("y")))), 6).alias("disagreement"))
