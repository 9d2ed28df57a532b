"""SimHash near-dedup (operator 8) with a Gray-order hierarchical index.

Distinct fingerprints are spread by bit patterns: 64 bits are six blocks, and two fingerprints within four bits
have at least two blocks in common, so each of the fifteen pairs of blocks gives a fingerprint one group to be
compared in. A group is sorted by Gray rank, which puts codes of few differences side by side; runs of codes are
nodes that keep the bits on which all agree, runs of nodes are upper nodes, and a pair of nodes is left out as
soon as the differences of their agreed bits exceed the bound. Groups beyond `most` members are split into salted
cells, a cell for each pair of salts. A group gives a spanning forest of its links, never its pairs; components
come from large-star/small-star rounds over these links.

Defined cases: a null or empty text has fingerprint zero and links like any other; repeated rows get equal results;
rows with a null doc_id are fingerprinted, and a component of nothing else has a null component_id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.components import connected
from inkspark.llm.words import apart
from inkspark.sources.shared import written

SHINGLE, SEED, DISTANCE, MOST = 4, 42, 4, 4096
WIDTHS = (11, 11, 11, 11, 10, 10)
LEAF = 16  # codes in a lowest node, and nodes in an upper one


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(distance: int = DISTANCE, widths: tuple[int, ...] = WIDTHS) -> list[int]:
    """Bit masks of the block sets of which two close fingerprints share one."""
    ends = np.cumsum((0, *widths))
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(ends, ends[1:])]
    return [sum(c) for c in combinations(blocks, len(widths) - distance)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist(), strict=True)], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column(1).fill_null("").cast(pa.binary()).to_pylist()
                found = pa.array([_signed(fingerprint(t, shingle)) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class Forest:
    """Roots of items under links that come in batches."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            open_ = a != b
            a, b = np.maximum(a[open_], b[open_]), np.minimum(a[open_], b[open_])
            if not len(a):
                break
            np.minimum.at(self.root, a, b)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _nodes(agreed: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper nodes: the bits on which all nodes of a run agree, and their values."""
    cuts = np.arange(0, len(value), LEAF)
    same_one = np.bitwise_and.reduceat(value & agreed, cuts)
    same_zero = np.bitwise_and.reduceat(~value & agreed, cuts)
    return same_one | same_zero, same_one


def link_group(codes: np.ndarray, forest: Forest, at: np.ndarray, distance: int) -> None:
    """Links codes of one group, sorted by Gray rank, through the hierarchy of their nodes."""
    levels = [(np.full(len(codes), ~np.uint64(0)), codes)]
    while len(levels[-1][1]) > 1:
        levels.append(_nodes(*levels[-1]))
    a = b = np.zeros(1, np.int64)
    fan = np.arange(LEAF)
    for agreed, value in reversed(levels[:-1]):
        size, out = len(value), []
        for k in range(0, len(a), 1 << 12):
            x = (a[k : k + (1 << 12), None, None] * LEAF + fan[None, :, None] + 0 * fan[None, None, :]).ravel()
            y = (b[k : k + (1 << 12), None, None] * LEAF + fan[None, None, :] + 0 * fan[None, :, None]).ravel()
            use = (x <= y) & (y < size)
            x, y = x[use], y[use]
            near = np.bitwise_count((value[x] ^ value[y]) & agreed[x] & agreed[y]) <= distance
            x, y = x[near], y[near]
            if size == len(codes):
                forest.link(at[x], at[y])
            else:
                out.append((x, y))
        if size != len(codes):
            a, b = (np.concatenate(z) for z in zip(*out, strict=True))


def link_sorted(group: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of rows that are sorted by group and Gray rank."""
    n = len(codes)
    forest = Forest(n)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    length = np.diff(np.append(first, n))
    small = np.repeat(length <= LEAF, length)
    for lag in range(1, min(LEAF, n)):
        near = small[lag:] & (group[lag:] == group[:-lag])
        if not near.any():
            break
        i = np.flatnonzero(near)
        i = i[np.bitwise_count(codes[i] ^ codes[i + lag]) <= distance]
        forest.link(i + lag, i)
    for f, m in zip(first[length > LEAF], length[length > LEAF], strict=True):
        link_group(codes[f : f + m], forest, np.arange(f, f + m), distance)
    v = np.flatnonzero(forest.root != np.arange(n))
    return codes[v], codes[forest.root[v]]


def links(prints: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """u, v: spanning links of the distinct fingerprints `fp` within `distance` bits."""
    sets = F.array(*(F.struct(F.lit(i).alias("pattern"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(masks(distance))))
    spread = prints.select("fp", F.explode(sets).alias("s")).select("fp", "s.*")
    hot = spread.groupBy("pattern", "part").count().filter(F.col("count") > most)
    cells = F.ceil(F.col("count") / most).cast("int")
    own = F.pmod(F.xxhash64("fp"), cells)
    others = F.transform(F.sequence(F.lit(0), cells - 1), lambda c: F.struct(F.least(c, own.cast("int")).alias("i"), F.greatest(c, own.cast("int")).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    dealt = spread.join(hot, ["pattern", "part"], "left").withColumn("cell", F.explode(F.when(F.col("count").isNull(), alone).otherwise(others)))
    keyed = dealt.select(F.xxhash64("pattern", "part", "cell.i", "cell.j").alias("bucket"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def found(last: bool) -> pa.RecordBatch | None:
            nonlocal held, size
            group, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(group) if last else int(np.searchsorted(group, group[-1]))
            held = [(group[cut:], codes[cut:])]
            size = len(group) - cut
            if not cut:
                return None
            group, codes = group[:cut], codes[:cut]
            order = np.lexsort((gray_rank(codes), group))
            u, v = link_sorted(group[order], codes[order], distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            size += batch.num_rows
            if size >= 1 << 18 and (out := found(False)) is not None:
                yield out
        if size and (out := found(True)) is not None:
            yield out

    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long").distinct()


def grouped(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id of each row of `docs`."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = written(connected(links(distinct.select("fp"), distance)), "roots")
    of = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` that stand for their component: those with its least doc_id. Rows without a doc_id stay,
    and so does each row that repeats that doc_id."""
    (i,) = apart(docs, "id")
    groups = grouped(docs, distance, shingle).filter("component_id = doc_id").select(F.col("doc_id").alias(i)).distinct()
    return docs.join(groups, docs["doc_id"] == groups[i], "left_semi").union(docs.filter("doc_id is null"))
