"""Benchmark decontamination (operator 5): size-partitioned MinHash containment search.

For a random order of all shingles, the least shingle of a test item lies in a document with a chance equal to the
item's containment there, however long the document. Items are partitioned by size into powers of two. The sizes of a
partition tell how large a share of an item may be missing at the threshold, and so how many orders make a miss rarer
than `miss`; items' minima form the index. They tell too how many of the items' shingles a document must have at
least, and a document with fewer is left out of the partition. A document's shingles are met with the index by an
equi-join, so that an item is found wherever in a long text it stands, and each candidate pair is verified by exact
containment of distinct shingles.

Words are runs of letters and digits (ASCII lower-cased, other ASCII bytes separate, others count as letters). A
sketch of fixed size, a bitmap of the items' shingles, only spares the join what no item can have.

Defined cases: null texts and texts or items of under `shingle` words match nothing; repeated items and repeated
documents give equal rows once; null ids match as ids of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.words import Words, apart, chunks, mix
from inkspark.sources.shared import written

SHINGLE, THRESHOLD, MISS = 5, 0.8, 1e-9
SKETCH_BITS = 23  # log2: 1 MB for any benchmark
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = False
APART[128:] = False


def _shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    w = Words(data, offsets, lower=True, space=APART)
    hashes, first = w.shingles(w.hashes(), k)
    return hashes, w.row[first]


def missing(size: int, threshold: float) -> float:
    """The largest share of its shingles that an item of `size` to 2 * `size` - 1 of them may lack."""
    return max((n - math.ceil(threshold * n - 1e-9)) / n for n in range(size, min(2 * size, size + 1000)))


def orders(size: int, threshold: float, miss: float) -> int:
    """Orders for a size partition: all their minima are lacking with a chance of `miss` at most."""
    lack = missing(size, threshold)
    return 1 if lack == 0 else max(1, math.ceil(math.log(miss) / math.log(lack))) if lack < 1 else size


def item_shingles(items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """item_id, part (size partition), shingles (distinct, ascending) and minima of each item that has a shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            hashes, row = _shingles(data, offsets, shingle)
            rows, found = [], []
            for i in np.unique(row).tolist():
                own = np.unique(hashes[row == i])
                part = len(own).bit_length() - 1
                n = orders(1 << part, threshold, miss)
                seeds = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
                least = np.unique([own[np.argmin(mix(own ^ s))] for s in seeds])
                rows.append(i)
                found.append((part, own.view(np.int64), least.view(np.int64)))
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([f[0] for f in found], pa.int32()), *(pa.array([f[j] for f in found], pa.list_(pa.int64())) for j in (1, 2))], names=["item_id", "part", "shingles", "minima"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, part int, shingles array<long>, minima array<long>")


def _sketch(found: DataFrame) -> np.ndarray:
    """Bits of the items' shingles; at most 2**SKETCH_BITS / 64 numbers come to the driver."""
    h = found.select(F.explode("shingles").alias("h")).select(F.shiftrightunsigned("h", 64 - SKETCH_BITS).alias("b"))
    words = h.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).collect()
    bits = np.zeros(1 << (SKETCH_BITS - 6), np.int64)
    for w, v in words:
        bits[w] = v
    return bits.view(np.uint64)


def _hits(docs: DataFrame, bits: np.ndarray, shingle: int) -> DataFrame:
    """doc_id, text_key, hits: the document's distinct shingles that the sketch has."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for batch, data, offsets in chunks(batches):
            hashes, row = _shingles(data, offsets, shingle)
            bit = hashes >> np.uint64(64 - SKETCH_BITS)
            use = (sketch[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            hashes, row = hashes[use], row[use]
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, bool)
            hashes, row = hashes[new], row[new]
            rows, at = np.unique(row, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)), pa.int32()), pa.array(hashes.view(np.int64)))
            pick = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), lists], names=["doc_id", "text_key", "hits"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key long, hits array<long>")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, miss: float = MISS) -> DataFrame:
    """doc_id, text_key, item_id, n_shingles, n_shared, containment of every pair at or above the threshold."""
    found = written(item_shingles(items, shingle, threshold, miss), "items").distinct()
    hits = written(_hits(docs, _sketch(found), shingle), "hits")
    index = found.select("item_id", "part", F.explode("minima").alias("h"))
    met = hits.select("doc_id", "text_key", F.size("hits").alias("has"), F.explode("hits").alias("h")).join(index, "h")
    met = met.filter(F.col("has") >= threshold * F.pow(F.lit(2), F.col("part")) - 1e-9)
    pairs = met.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("item_id").alias("i"), "part").distinct()
    own = found.select("item_id", F.col("part").alias("p"), "shingles")
    both = pairs.join(own, pairs["i"].eqNullSafe(own["item_id"]) & (pairs["part"] == own["p"])).join(hits.distinct(), F.col("d").eqNullSafe(F.col("doc_id")) & F.col("k").eqNullSafe(F.col("text_key")))
    n, shared = F.size("shingles"), F.size(F.array_intersect("shingles", "hits"))
    measured = both.select("doc_id", "text_key", "item_id", n.cast("long").alias("n_shingles"), shared.cast("long").alias("n_shared"))
    return measured.filter(F.col("n_shared") >= threshold * F.col("n_shingles")).withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6)).distinct()


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` that hold no test item, with all their columns."""
    i, k = apart(docs, "id", "key")
    gone = contained(docs, items, threshold, shingle).select(F.col("doc_id").alias(i), F.col("text_key").alias(k)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[i]) & (F.xxhash64(docs["text"]) == gone[k]), "left_anti")
