"""All queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.operators import ngrams
from inkspark.plans import case_queries, decoding_queries, derived_queries, evaluation_queries, phonetic_queries, score_queries, text_queries
from inkspark.plans.registry import QUERIES, SQL, Query, table

__all__ = ["case_queries", "decoding_queries", "derived_queries", "evaluation_queries", "flagship", "oracle_sql", "phonetic_queries", "queries", "score_queries", "text_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter pairs of documents by pointwise mutual information."""
    grams = ngrams.run_grams(table(spark, sf_dir, "documents"), (1, 2), script="latin", repeat=True)
    return ngrams.pmi(grams).withColumn("pmi", F.round("pmi", 6)).orderBy(F.desc("pmi"), "gram")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
