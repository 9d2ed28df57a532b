"""LM scoring (operator 9): deleted interpolation of unigrams and bigrams.

log10 P(text) is the sum over its tokens (lower-cased words, then one end) of
log10(a2 c(h w)/c(h) + a1 c(w)/N + a0/(V+1)), h the token before or the start. The weights a depend on the bucket
of c(h), its number of binary digits, and are learned by expectation-maximisation on a deleted part of the training
documents under the counts of the rest; then all training documents' counts are used.

Counts never gather in one place. Documents are taken in chunks of a few MB; a chunk asks each key bucket about its
distinct words and pairs (sorted 64-bit hashes with its own counts), the bucket sums the chunks' counts and answers
each chunk in its own order, and the chunk scores its documents. A frequent word is one entry a chunk, however often it
stands there, and all that is moved grows in proportion to the input; a bucket's group holds one row for each chunk that
asks it. The driver gets three totals and, for the weights,
a histogram over a fixed grid (context bucket and two log ratios in quarter octaves).

Defined cases: a null or empty text is the end alone; a null doc_id is training data; repeated rows count and are
scored each; without training documents N and V are 0 and both scores follow from the same formulas with weight a0;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.sources.shared import written
from inkspark.llm.words import Words, chunks, mix, trimmed

PARTS, HELD_OUT, DELETED = 7, 2, 3  # crc32(doc_id as text) mod PARTS: what is held out, and deleted to learn weights
TRAIN, DELETED_ROLE, HELD_ROLE = 0, 1, 2
CHUNK, SLICE = 3 << 20, 1 << 20  # bytes of text that share one set of requests; that are hashed at a time
BUCKET_TOKENS = 4 << 20  # tokens a key bucket stands for
TASK_TOKENS = 4 << 20  # tokens whose requests and answers a task takes
END, START = np.uint64(1), np.uint64(2)  # in place of word hashes
GRID, CONTEXTS = 4, 48  # steps an octave; context buckets
ROUNDS, PRIOR_EVENTS = 60, 50.0


def _packed(x: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _chunked(docs: DataFrame) -> DataFrame:
    """A row for each chunk: its role, documents, their token counts, distinct word hashes and tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % PARTS, F.lit(-1))
    role = F.when(part == HELD_OUT, HELD_ROLE).when(part == DELETED, DELETED_ROLE).otherwise(TRAIN)
    names = ["chunk", "role", "docs", "lengths", "words", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[pa.Array, np.ndarray, np.ndarray, int]]] = {r: [] for r in (TRAIN, DELETED_ROLE, HELD_ROLE)}

        def chunk(r: int) -> pa.RecordBatch:
            nonlocal number
            ids, lengths, hashes, _ = zip(*held[r], strict=True)
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            listed = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            row = [pa.array([number]), pa.array([r], pa.int32()), listed(pa.concat_arrays(ids)), listed(pa.array(np.concatenate(lengths), pa.int32())), pa.array([_packed(np.diff(words, prepend=np.uint64(0)))], pa.binary()), pa.array([_packed(tokens)], pa.binary())]
            held[r], number = [], number + 1
            return pa.RecordBatch.from_arrays(row, names=names)

        for batch in batches:
            trimmed()
            for r in held:
                for some, data, offsets in chunks(iter([batch.filter(pc.equal(batch.column("role"), r))]), limit=SLICE):
                    w = Words(data, offsets, lower=True)
                    hashes = np.full(len(w.start) + len(w.counts), END, np.uint64)
                    hashes[np.arange(len(w.start)) + w.row] = np.maximum(w.hashes(), np.uint64(3))
                    held[r].append((some.column("doc_id"), w.counts + 1, hashes, len(data)))
                    if sum(h[3] for h in held[r]) >= CHUNK:
                        yield chunk(r)
        for r in held:
            if held[r]:
                yield chunk(r)

    schema = f"chunk long, role int, docs array<{kind}>, lengths array<int>, words binary, tokens binary"
    return docs.select("doc_id", role.alias("role"), "text").mapInArrow(run, schema)


class Chunk:
    """A chunk's tokens with its sorted keys: distinct words, and distinct pairs of a word and the one before."""

    def __init__(self, lengths: np.ndarray, words: bytes, tokens: bytes):
        self.words = np.cumsum(_unpacked(words), dtype=np.uint64)
        self.tokens = _unpacked(tokens).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        n = len(self.words)
        self.before = np.concatenate([[n], self.tokens[:-1]])
        self.before[self.first] = n  # the start
        codes, self.pair, self.pair_counts = np.unique(self.before * (n + 1) + self.tokens, return_inverse=True, return_counts=True)
        known = np.append(self.words, START)
        pairs = mix(known[codes // (n + 1)] * np.uint64(0x9E3779B97F4A7C15) + known[codes % (n + 1)])
        self.pair_order = np.argsort(pairs)
        self.pairs = pairs[self.pair_order]
        self.word_counts = np.bincount(self.tokens, minlength=n)

    def keys(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, keys in ascending order, their counts here)."""
        mixed = mix(self.words)
        order = np.argsort(mixed)
        return [(1, mixed[order], self.word_counts[order]), (2, self.pairs, self.pair_counts[self.pair_order])]

    def answered(self, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the counts of it, of the token before, and of both, from answers in the keys' order."""
        of_word, of_pair = np.empty(len(words) + 1, np.int64), np.empty(len(pairs), np.int64)
        of_word[np.argsort(mix(self.words))] = words
        of_word[-1] = 0  # the start: filled in by the caller
        of_pair[self.pair_order] = pairs
        return of_word[self.tokens], of_word[self.before], of_pair[self.pair]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, Chunk]]:
    for i in range(batch.num_rows):
        trimmed()
        lengths = batch.column("lengths")[i].values.to_numpy()
        yield i, Chunk(lengths, batch.column("words")[i].as_py(), batch.column("tokens")[i].as_py())


def _requests(table: DataFrame, bits: int) -> DataFrame:
    """kind, bucket, chunk, role, keys and counts of each chunk and bucket with keys."""
    names = ["kind", "bucket", "chunk", "role", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in _rows(batch):
                number, role = batch.column("chunk")[i].as_py(), batch.column("role")[i].as_py()
                for kind, keys, counts in chunk.keys():
                    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
                    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
                    parts = [(_packed(np.diff(keys[a:b], prepend=np.uint64(0))), _packed(counts[a:b])) for a, b in zip(cuts, cuts[1:])]
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(bucket[cuts[:-1]]), pa.array([number] * n, pa.int64()), pa.array([role] * n, pa.int32()), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], names=names)

    return table.select("chunk", "role", "lengths", "words", "tokens").mapInArrow(run, "kind int, bucket long, chunk long, role int, keys binary, counts binary")


def _answer(rows: pa.Table) -> pa.Table:
    """Training and remaining (without the deleted part) counts for each chunk of a bucket, in its keys' order; and,
    for chunk -1, how many keys have one."""
    trimmed()
    keys = [np.cumsum(_unpacked(k), dtype=np.uint64) for k in rows.column("keys").to_pylist()]
    counts = [_unpacked(c).astype(np.int64) for c in rows.column("counts").to_pylist()]
    role = np.repeat(rows.column("role").to_numpy(), [len(k) for k in keys])
    each = np.concatenate(counts)
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    full = np.bincount(inverse, np.where(role != HELD_ROLE, each, 0), len(every)).astype(np.int64)
    rest = np.bincount(inverse, np.where(role == TRAIN, each, 0), len(every)).astype(np.int64)
    cuts = np.cumsum([0, *map(len, keys)]).tolist()
    spans = [inverse[a:b] for a, b in zip(cuts, cuts[1:])]
    n = len(spans)
    out = [[*rows.column(c).to_pylist(), rows.column(c)[0].as_py()] for c in ("kind", "bucket")]
    return pa.Table.from_arrays([
        pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array([*rows.column("chunk").to_pylist(), -1], pa.int64()),
        pa.array([*(_packed(full[s]) for s in spans), b""], pa.binary()), pa.array([*(_packed(rest[s]) for s in spans), b""], pa.binary()),
        pa.array([0] * n + [int((full > 0).sum())], pa.int64()), pa.array([0] * n + [int((rest > 0).sum())], pa.int64()),
    ], names=["kind", "bucket", "chunk", "full", "rest", "full_types", "rest_types"])


def _joined(answers: DataFrame, table: DataFrame, tasks: int) -> DataFrame:
    """Each chunk with its answers (an array of kind, bucket, full, rest)."""
    by = answers.filter("chunk >= 0").repartition(tasks, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "full", "rest")).alias("answers"))
    return table.join(by, "chunk")


def _counts(answers: list[dict], which: str) -> list[np.ndarray]:
    ordered = sorted(answers, key=lambda a: (a["kind"], a["bucket"]))
    return [np.concatenate([_unpacked(a[which]) for a in ordered if a["kind"] == k]).astype(np.int64) for k in (1, 2)]


def _context(c: np.ndarray) -> np.ndarray:
    """Buckets of context counts: the number of binary digits."""
    return np.minimum(np.frexp(c.astype(float))[1], CONTEXTS - 1)


def _chances(c: np.ndarray, h: np.ndarray, both: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    return both / np.maximum(h, 1), c / max(total, 1)


def _histogram(joined: DataFrame, total: int, types: int, documents: int) -> DataFrame:
    """context, pair, word (log ratios to the uniform chance in 1/GRID octaves, -1 for none), n over the deleted part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in _rows(batch):
                c, h, both = chunk.answered(*_counts(batch.column("answers")[i].as_py(), "rest"))
                h[chunk.first] = documents
                steps = [np.where(p > 0, 1 + np.maximum(0, np.round(GRID * np.log2(np.maximum(p, 1e-300) * (types + 1)))), 0).astype(np.int64) for p in _chances(c, h, both, total)]
                cell, n = np.unique((_context(h).astype(np.int64) << 40) | (steps[0] << 20) | steps[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (cell >> 40, (cell >> 20) & 0xFFFFF, cell & 0xFFFFF, n)], names=["context", "pair", "word", "n"])

    cells = joined.select("lengths", "words", "tokens", "answers").mapInArrow(run, "context long, pair long, word long, n long")
    return cells.groupBy("context", "pair", "word").agg(F.sum("n").alias("n"))


def learned(cells: np.ndarray) -> np.ndarray:
    """Weights (pair, word, uniform) of each context bucket by expectation-maximisation; cells: context, pair, word, n.

    A bucket's expectations are joined by PRIOR_EVENTS events with the weights of all buckets together, so one with few
    events has nearly those."""
    ratio = np.stack([np.where(cells[:, j] > 0, 2.0 ** ((cells[:, j] - 1) / GRID), 0) for j in (1, 2)] + [np.ones(len(cells))], axis=1) if len(cells) else np.zeros((0, 3))

    def solved(use: np.ndarray, start: np.ndarray, prior: float) -> np.ndarray:
        a, n = start, cells[use, 3]
        for _ in range(ROUNDS):
            share = a * ratio[use]
            a = ((share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) + prior * start) / (n.sum() + prior)
        return np.maximum(a, 1e-12) / np.maximum(a, 1e-12).sum()

    if not len(cells):
        return np.tile([0.0, 0.0, 1.0], (CONTEXTS, 1))
    every = solved(np.ones(len(cells), bool), np.full(3, 1 / 3), 0.0)
    return np.stack([solved(cells[:, 0] == b, every, PRIOR_EVENTS) for b in range(CONTEXTS)])


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of `docs`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = written(_chunked(docs), "chunks")
    size = table.groupBy("role").agg(F.sum(F.size("lengths")).alias("documents"), F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("tokens")).collect()
    documents, tokens = ({r["role"]: r[k] for r in size} for k in ("documents", "tokens"))
    bits = max(4, (sum(tokens.values()) // BUCKET_TOKENS).bit_length())
    # Tasks by size: the shuffles hold some twelve bytes a token in all.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(tokens.values()) // TASK_TOKENS))
    answers = written(_requests(table, bits).repartition(tasks, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(_answer, "kind int, bucket long, chunk long, full binary, rest binary, full_types long, rest_types long"), "answers")
    types = answers.filter("chunk < 0 and kind = 1").agg(F.coalesce(F.sum("full_types"), F.lit(0)), F.coalesce(F.sum("rest_types"), F.lit(0))).first()
    full_total, rest_total = tokens.get(TRAIN, 0) + tokens.get(DELETED_ROLE, 0), tokens.get(TRAIN, 0)
    full_docs, rest_docs = documents.get(TRAIN, 0) + documents.get(DELETED_ROLE, 0), documents.get(TRAIN, 0)
    deleted = _joined(answers, table.filter(F.col("role") == DELETED_ROLE), tasks)
    cells = _histogram(deleted, rest_total, types[1], rest_docs).collect()
    weights = learned(np.array([tuple(c) for c in cells], float).reshape(-1, 4))
    n, v = full_total, types[0]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in _rows(batch):
                c, h, both = chunk.answered(*_counts(batch.column("answers")[i].as_py(), "full"))
                h[chunk.first] = full_docs
                pair, word = _chances(c, h, both, n)
                a = weights[_context(h)]
                by_doc = lambda x: np.add.reduceat(x, chunk.first)
                score = by_doc(np.log10(a[:, 0] * pair + a[:, 1] * word + a[:, 2] / (v + 1)))
                base = by_doc(np.log10(c + 1.0)) - by_doc(np.ones(len(c))) * np.log10(float(n + v + 1))
                ids = batch.column("docs")[i].values
                held = batch.column("role")[i].as_py() == HELD_ROLE
                yield pa.RecordBatch.from_arrays([ids, pa.array([held] * len(ids)), pa.array(by_doc(np.ones(len(c), np.int64))), pa.array(by_doc((c > 0).astype(np.int64))), pa.array(np.full(len(ids), n)), pa.array(base), pa.array(score)], names=names)

    return _joined(answers, table, tasks).mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
