"""Sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _text_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file in the file system of its path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def sentences(rows: DataFrame, path: str) -> None:
    """JSON lines by source and split; the contributor is not written."""
    rows.drop("contributor").write.mode("overwrite").partitionBy("source_id", "split").json(path)


def attribution(rows: DataFrame, path: str) -> None:
    rows.groupBy("contributor").agg(F.count(F.lit(1)).alias("sentences")).write.mode("overwrite").csv(path, sep="\t", header=True)


def manifest(spark: SparkSession, path: str, facts: dict) -> None:
    _text_file(spark, path, json.dumps(facts, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def ngram_table(counts: DataFrame, path: str, facts: dict | None = None) -> None:
    """Parquet in the grams' order, so that a lookup reads few row groups; a manifest beside it counts tokens and grams."""
    counts.repartitionByRange("n", "gram").sortWithinPartitions("n", "gram").write.mode("overwrite").partitionBy("n").parquet(path)
    if facts is not None:
        sizes = {str(r["n"]): r["g"] for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("g")).collect()}
        total = counts.filter("n = 1").agg(F.sum("c")).first()[0] or 0
        manifest(counts.sparkSession, path.rstrip("/") + ".manifest.json", {**facts, "grams": sizes, "tokens": total})


def lexicon(entries: DataFrame, path: str) -> None:
    """Sorted by reading: one reading's entries lie together, and a lookup skips the other row groups."""
    entries.repartitionByRange("reading").sortWithinPartitions("reading", F.desc("frequency"), "text").write.mode("overwrite").parquet(path)


def _lines(rows: DataFrame, path: str, header: str) -> None:
    """Text with commented header lines: the header is a part file that sorts before the rows'."""
    rows.write.mode("overwrite").text(path)
    _text_file(rows.sparkSession, path.rstrip("/") + "/part-00000-0-header.txt", "".join(f"# {line}\n" for line in header.splitlines()))


def char_readings(rows: DataFrame, path: str, header: str) -> None:
    """TSV of char, reading, cns_code under a licence header."""
    _lines(rows.select(F.concat_ws("\t", "char", "reading", "cns_code").alias("value")), path, header)


def derived_entries(entries: DataFrame, path: str) -> None:
    entries.orderBy("text").write.mode("overwrite").json(path)


def cases(rows: DataFrame, path: str, header: str = "") -> None:
    """JSON lines under a commented header."""
    _lines(rows.select(F.to_json(F.struct(*rows.columns)).alias("value")), path, header)
