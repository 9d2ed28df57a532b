"""Queries over evaluation cases: alternates, tone swaps, stages of loss, run summaries, groups, changed items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.operators import cases, lexicons
from inkspark.plans.registry import query, table


@query("""WITH c AS (SELECT event_type, event_id % 7 <> 0 AS reachable, CASE WHEN event_id % 5 <> 0 THEN event_id % 11 END AS final_rank, CASE WHEN event_id % 3 <> 0 THEN event_id % 11 END AS rank FROM events)
SELECT event_type, CASE WHEN NOT reachable THEN 'unreachable' WHEN final_rank IS NULL THEN 'beam_pruned' WHEN rank IS NULL THEN 'outside_output' WHEN rank >= 5 THEN 'generated_ranked_low' ELSE 'top5' END AS stage, count(*) AS n FROM c GROUP BY ALL""")
def loss_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_type", (i % 7 != 0).alias("reachable"), F.when(i % 5 != 0, i % 11).alias("final_rank"), F.when(i % 3 != 0, i % 11).alias("rank"))
    return rows.groupBy("event_type", cases.loss_stage("reachable", "final_rank", "rank").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 3) AS mean, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95, round(quantile_cont(value, 0.99), 3) AS p99 FROM events GROUP BY 1")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.run_summary(table(spark, sf_dir, "events"), "value", ("event_type",))


@query("""WITH a AS (SELECT n_name, CASE WHEN contains(n_name, 'A') THEN [n_name, replace(n_name, 'A', 'E')] ELSE [n_name] END AS o FROM nation)
SELECT n_name, array_to_string(list_concat(o, list_transform(list_filter(o, lambda x: contains(x, 'I')), lambda x: replace(x, 'I', 'Y'))), '|') AS options FROM a""")
def alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_name", F.array_join(cases.alternates("n_name", (("A", "E"), ("I", "Y"))), "|").alias("options"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels EXCEPT ALL SELECT doc_id, quality, toxic FROM labels")
def changed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    after = before.withColumn("quality", F.when(F.col("doc_id") % 10 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return cases.changed(after, before)


@query("SELECT source, row_number() OVER (ORDER BY source) AS number FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def provenance_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.numbered(table(spark, sf_dir, "documents").select("source").filter("source is not null").distinct(), "source").select("source", "number")
