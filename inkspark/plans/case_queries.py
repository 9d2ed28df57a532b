"""Queries over cases and candidates: rankings, metrics, paired tests and the keyboard.

A case is a user and its candidates are the user's events, with the value as score and the event's number as base
order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions import phonetics
from inkspark.operators import metrics, ranking
from inkspark.plans.registry import query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rank FROM events")
def order_by_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ordered(_events(spark, sf_dir), "user_id", "value", "event_id").select("user_id", "event_id", "rank")


_SHARE = "r AS (SELECT *, pow(10, (value - max(value) OVER w) / 100) AS r FROM events WINDOW w AS (PARTITION BY user_id)), share AS (SELECT *, r / sum(r) OVER (PARTITION BY user_id) AS share, 1.0::DOUBLE / count(*) OVER (PARTITION BY user_id) AS flat FROM r)"


@query(f"WITH {_SHARE}, m AS (SELECT user_id, event_id, 0.6::DOUBLE * share + 0.4::DOUBLE * flat AS mixed FROM share) SELECT user_id, event_id, round(mixed, 6) AS mixed FROM m")
def hybrid_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("s", F.col("value") / 100)
    counts = rows.groupBy("user_id").agg((F.lit(1.0) / F.count(F.lit(1))).alias("flat"))
    return ranking.mixed(rows.join(counts, "user_id"), "user_id", "s", "flat", 0.4, "event_id").select("user_id", "event_id", F.round("mixed", 6).alias("mixed"))


@query(f"""WITH {_SHARE}, t AS (SELECT user_id, count(*) AS n, -sum(CASE WHEN share > 0 THEN share * ln(share) ELSE 0 END) AS h, list_reverse_sort(list(share)) AS l FROM share GROUP BY 1),
m AS (SELECT user_id, CASE WHEN n > 1 THEN l[1] - l[2] ELSE 0 END AS margin, CASE WHEN n > 1 THEN h / ln(n) ELSE 0 END AS entropy, n FROM t),
g AS (SELECT *, CASE WHEN n > 1 THEN least(1, greatest(0, (margin - 0.05) / 0.25)) * (1 - least(1, greatest(0, (entropy - 0.7) / 0.25))) ELSE 0 END AS gate FROM m)
SELECT user_id, round(margin, 6)::DOUBLE AS margin, round(entropy, 6)::DOUBLE AS entropy, round(gate, 6)::DOUBLE AS gate FROM g""")
def entropy_margin_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.share10(_events(spark, sf_dir).withColumn("s", F.col("value") / 100), "user_id", "s")
    out = ranking.confidence(rows, "user_id", "share")
    return out.select("user_id", *(F.round(c, 6).alias(c) for c in ("margin", "entropy", "gate")))


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's few options: the kinds of a user's events, judged by their mean value."""
    return _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))


_PREFS = "o AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL), f AS (SELECT a.user_id, a.event_type AS a, b.event_type AS b, a.v / (a.v + b.v) AS f FROM o a JOIN o b USING (user_id) WHERE a.event_type <> b.event_type)"


@query(f"WITH {_PREFS}, w AS (SELECT user_id, a, avg(f) AS w FROM f GROUP BY ALL) SELECT user_id, a AS option, round(w / sum(w) OVER (PARTITION BY user_id), 6) AS p FROM w")
def pairwise_mean_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefs = ranking.preferences(_types(spark, sf_dir), "user_id", "event_type", "v")
    return ranking.mean_wins(prefs, "user_id").withColumn("p", F.round("p", 6))


@query()
def bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefs = ranking.preferences(_types(spark, sf_dir), "user_id", "event_type", "v")
    return ranking.bradley_terry(prefs, "user_id").withColumn("p", F.round("p", 6))


_RANKS = """r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rank, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS base FROM events),
o AS (SELECT user_id, min(rank) FILTER (event_type = 'purchase') AS rank, min(base) FILTER (event_type = 'purchase') AS base FROM r GROUP BY 1)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, rank and base: where the first purchase stands by value and by time; null for none."""
    from pyspark.sql.window import Window

    rows = ranking.ordered(_events(spark, sf_dir), "user_id", "value", "event_id").withColumn("base", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    hit = F.col("event_type") == "purchase"
    return rows.groupBy("user_id").agg(F.min(F.when(hit, F.col("rank"))).alias("rank"), F.min(F.when(hit, F.col("base"))).alias("base"))


_OUTCOMES = f"WITH {_RANKS}, x AS (SELECT coalesce(rank, 1000000) AS rank, coalesce(base, 1000000) AS base FROM o)"


@query(f"""{_OUTCOMES} SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank < 1000000 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr,
round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_10,
count(*) FILTER (rank < base) AS improved, count(*) FILTER (rank > base) AS worse, count(*) FILTER (rank = base) AS same FROM x""")
def recall_mrr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.summary(_outcomes(spark, sf_dir), "rank", "base")
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("top1", "mrr", "recall_3", "recall_5", "recall_10")), "improved", "worse", "same")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(metrics.linear_percentile("value", 0.5), 6).alias("p50"), F.round(metrics.linear_percentile("value", 0.95), 6).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, list_sort(list(value))[round_even(0.95 * (count(*) - 1), 0)::INT + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest(_events(spark, sf_dir), "value", (0.95,), ("user_id",))


_LABELS = "SELECT l.doc_id, d.lang, quality = 1 AS before, (quality = 1 AND toxic = 0) OR (quality = 0 AND d.n_chars % 3 = 0) AS after FROM labels l JOIN documents d USING (doc_id)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang and two systems' outcomes, made from the labels."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    good = F.col("quality") == 1
    return rows.select("doc_id", "lang", good.alias("before"), ((good & (F.col("toxic") == 0)) | (~good & (F.col("n_chars") % 3 == 0))).alias("after"))


@query(f"WITH x AS ({_LABELS}) SELECT lang, before, after, count(*) AS n FROM x GROUP BY ALL")
def paired_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("lang", "before", "after").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH x AS ({_LABELS}), t AS (SELECT lang, count(*) FILTER (NOT before AND after) AS gained, count(*) FILTER (before AND NOT after) AS lost FROM x GROUP BY 1),
c AS (SELECT *, list_sum(list_transform(range(0, least(gained, lost) + 1), lambda i: exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2)))) AS s FROM t)
SELECT lang, gained, lost, round(least(1.0, 2 * s), 6) AS p FROM c""")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.paired(_labelled(spark, sf_dir), "before", "after", ("lang",)).withColumn("p", F.round("p", 6))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY CUBE (quality, toxic)")
def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").cube("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT role, turn, count(*) AS n, round(avg(len(text)), 6) AS mean_chars FROM conversations GROUP BY ALL")
def role_turn_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role", "turn").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


@query("WITH rows(r, s) AS (VALUES (0, '1234567890-'), (1, 'qwertyuiop'), (2, 'asdfghjkl;'), (3, 'zxcvbnm,./')), k AS (SELECT r, unnest(range(0, len(s))) AS c, s FROM rows), spots AS (SELECT r, c, s[c + 1] AS key FROM k) SELECT a.key AS key, b.key AS neighbour FROM spots a JOIN spots b ON (b.r = a.r AND abs(b.c - a.c) = 1) OR (b.r = a.r - 1 AND b.c IN (a.c, a.c + 1)) OR (b.r = a.r + 1 AND b.c IN (a.c - 1, a.c))")
def adjacent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phonetics.keyboard(spark).select("key", F.explode("neighbours").alias("neighbour"))
