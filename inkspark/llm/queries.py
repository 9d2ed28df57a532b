"""The operators' queries over the whole tables, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm import decontam, edits, interpolation, line_dedup, outliers, packing, personal, secrets, simhash, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = outliers.judged(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2", "level")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text without the lines that go, and how many lines it had and lost."""
    out = line_dedup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_lost").alias("n_lost"), F.col("_near").alias("n_near"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op4_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its tokens before and after three edits, at three quarters, half and a quarter of the text."""
    state = edits.built(_table(spark, sf_dir, "documents"))
    # The heap's root is the text's length.
    at = [f"cast(chars[1] * {k} / 4 as long)" for k in (3, 2, 1)]
    made = F.expr("array(" + ", ".join(f"named_struct('start', {p}, 'end', {p} + {cut}, 'new', '{new}')" for p, cut, new in zip(at, (5, 0, 7), ("", " put in ", "changed"), strict=True)) + ")")
    out = edits.edited(state.withColumn("edits", made))
    return out.select("doc_id", "n_before", F.col("n_tokens").alias("n_after"), F.size("parts").cast("long").alias("n_leaves"), "n_encoded")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


def op6_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits of one history: the first holds the lower half of ids and is scanned by the base rules, the second
    holds all documents and has all rules, and only what the first one's ledger lacks is evaluated."""
    docs = _table(spark, sf_dir, "documents")
    half = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    first = docs.crossJoin(F.broadcast(half)).filter("doc_id <= (a + b) / 2").select("doc_id", "text")
    _, ledger = secrets.scanned(first, None, tuple(r for r in secrets.RULES if r.base))
    found, _ = secrets.scanned(docs.select("doc_id", "text"), ledger)
    return secrets.digests(found)


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(personal.detected(_table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.grouped(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.scored(_table(spark, sf_dir, "documents"))


def op10_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


#: Operator 2 from its definition: equal lines, and pairs with one word put in, taken out or replaced. Any such
#: pair has a half in common, so candidates meet on halves; which lines go does not depend on how they are found.
LINE_DEDUP = r"""
WITH cut AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents
), words AS (
  SELECT doc_id, line_no, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM cut
), firsts AS (
  SELECT w, min((doc_id, line_no)) AS place, len(w) AS n FROM words WHERE len(w) > 0 GROUP BY w
), halves AS (
  SELECT w, place, n, n AS base, n // 2 AS m FROM firsts WHERE n >= 5
  UNION ALL SELECT w, place, n, n - 1, (n - 1) // 2 FROM firsts WHERE n >= 5
), keys AS (
  SELECT *, (base, 'p', w[1 : m]) AS k FROM halves
  UNION ALL SELECT *, (base, 's', w[n - (base - m) + 1 :]) FROM halves
), near AS (
  SELECT DISTINCT b.w AS w FROM keys a JOIN keys b ON a.k = b.k AND a.place < b.place
  WHERE CASE WHEN a.n = b.n THEN len(list_filter(range(1, a.n + 1), lambda i: a.w[i] <> b.w[i])) <= 1
    WHEN a.n = b.n + 1 THEN len(list_filter(range(1, a.n + 1), lambda i: list_concat(a.w[1 : i - 1], a.w[i + 1 :]) = b.w)) > 0
    WHEN b.n = a.n + 1 THEN len(list_filter(range(1, b.n + 1), lambda i: list_concat(b.w[1 : i - 1], b.w[i + 1 :]) = a.w)) > 0
    ELSE false END
), judged AS (
  SELECT words.*, len(words.w) > 0 AS worded, len(words.w) > 0 AND (place <> (doc_id, line_no)) AS again,
    len(words.w) > 0 AND place = (doc_id, line_no) AND near.w IS NOT NULL AS close
  FROM words LEFT JOIN firsts ON words.w = firsts.w LEFT JOIN near ON words.w = near.w
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT (again OR close)), '') AS text,
  count(*) FILTER (worded) AS n_lines, count(*) FILTER (again OR close) AS n_lost, count(*) FILTER (close) AS n_near
FROM judged GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0, 0 FROM documents WHERE text IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP}
