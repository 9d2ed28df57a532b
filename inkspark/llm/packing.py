"""Best-fit packing (operator 3): bounded-space online best fit.

Every document's ids (and the closing id) go into sequences of at most `capacity` tokens; only longer documents
are cut. A task packs the documents of its own partition, so no token is shuffled and a lost task is simply run
again. It is online: each piece is placed for good as it comes. At most `open_bins` sequences are open, in a bitset
keyed by free space: the best fit is the lowest set bit at or above the piece's length, and when all are open the
fullest one, the lowest set bit of all, is closed. Of sequences with equal free space the one opened or filled last
is taken.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed each; an empty table gives an
empty result; a very long text is cut into full pieces and one rest; pieces of equal length go in the order of rows;
other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from inkspark.llm.words import chunks

CAPACITY, CLOSING_ID, OPEN_BINS, ROWS = 4096, 1, 64, 8192
SLICE = 3 << 20  # bytes of text that are encoded at a time, or one text

#: Pieces that the tokenizer cuts lower-case words into, where they hold no apostrophe: letters, digits one by one, marks.
PIECES, WIDE_PIECES = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+"), re.compile(r"[^\W\d_]+|[0-9]|[\W_]+")


class CachedEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, with the ids of known words at hand.

    The tokenizer's pieces never hold white space, so a text's ids are those of its words in turn, and a word's those of
    its pieces. Letters unknown so far are encoded many words at a time: in a line of words of letters each ends with
    the one piece that has a word end.
    The memory is bounded: beyond `limit` words a new generation begins, and of the last one only those that come again
    are taken over.
    """

    def __init__(self, file: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(file), limit
        self.known: dict[bytes, bytes] = {b"": b""}
        self.last: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _each(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(words, found, strict=True))

    def _plain(self, words: list[bytes]) -> None:
        lines = [words[i : i + 500] for i in range(0, len(words), 500)]
        found = self.tokenizer.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False)
        for some, e in zip(lines, found, strict=True):
            ids = np.array(e.ids, "<u4")
            at = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(at) != len(some):
                self._each(some)
                continue
            raw, at = ids.tobytes(), [0, *at.tolist()]
            self.known.update(zip(some, map(raw.__getitem__, map(slice, at[:-1], at[1:])), strict=True))

    def _recalled(self, words: set[bytes]) -> set[bytes]:
        """Takes over what the last generation knew; the words that are left."""
        words = words.difference(self.known)
        if not self.last:
            return words
        last = self.last
        again = {w: last[w] for w in words if w in last}
        self.known.update(again)
        return words.difference(again)

    def _learn(self, words: set[bytes]) -> None:
        plain, single, cut = [], [], {}
        for w in self._recalled(words):
            if w.isalpha():
                plain.append(w)
            elif b"'" in w or b"<|" in w:
                single.append(w)
            elif w.isascii():
                cut[w] = PIECES.findall(w.lower())
            else:
                t = w.decode("utf-8", "replace").lower()
                if max(t) >= "\u0250" or "\u0307" in t or not all(c.isascii() or c.isalpha() for c in t):
                    single.append(w)
                elif t.isalpha():
                    plain.append(w)
                else:
                    cut[w] = [p.encode() for p in WIDE_PIECES.findall(t)]
        pieces = self._recalled(set().union(*cut.values()))
        letters = {p for p in pieces if p[-1:].isalpha() or p[-1] > 127}
        self._plain([*plain, *letters.difference(plain)])
        self._each([*single, *pieces.difference(letters)])
        known = self.known
        known.update((w, b"".join([known[p] for p in parts])) for w, parts in cut.items())

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of strings, one text after another, and where each text's begin and end.

        Words are told apart and looked up once for the whole column; their ids are then laid out by arrays."""
        if len(self.known) > self.limit:
            self.known, self.last = {b"": b""}, self.known
        # Letter case is lost in any case, but marked-up tokens and combining marks are looked at as they are.
        marked = pc.match_substring_regex(texts, "<\\||[\u0300-\u037f]")
        listed = pc.ascii_split_whitespace(pc.if_else(marked, texts, pc.ascii_lower(texts)))
        of = listed.flatten().dictionary_encode()
        at, words = of.indices.to_numpy(), of.dictionary.cast(pa.binary()).to_pylist()
        self._learn({*words})
        ids = [*map(self.known.__getitem__, words)]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4")
        each = size[at]
        end = np.concatenate([[0], np.cumsum(each)])
        place = np.arange(end[-1]) + np.repeat(start[at] - end[:-1], each)
        bounds = listed.offsets.to_numpy()
        return flat[place], end[bounds - bounds[0]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        ids, ends = self.column(pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]


_encoders: dict[str, CachedEncoder] = {}


def encoder(file: str) -> CachedEncoder:
    """One for each Python worker, kept between its tasks."""
    if file not in _encoders:
        _encoders[file] = CachedEncoder(file)
    return _encoders[file]


class OpenBins:
    """At most `most` open sequences, in a bitset keyed by free space."""

    def __init__(self, capacity: int, most: int, number: int):
        self.capacity, self.most, self.number = capacity, most, number
        self.bits, self.count = 0, 0
        self.at: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        same = self.at[free]
        found = same.pop()
        if not same:
            del self.at[free]
            self.bits ^= 1 << free
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The sequence that gets a piece, and the piece's offset there."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.count == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, sequence = self.capacity, self.number
            self.number += 1
        left = free - length
        if left:
            if left not in self.at:
                self.at[left] = []
                self.bits |= 1 << left
            self.at[left].append(sequence)
            self.count += 1
        return sequence, self.capacity - free


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    file = tokenizer or tokenizer_file()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing, known = closing_id.to_bytes(4, "little"), encoder(file)
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        placed: list[tuple] = []
        id_type = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*placed, strict=True))
            placed.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, pa.int32(), *[pa.int64()] * 5], strict=True)], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for part, _, _ in chunks(iter([batch]), limit=SLICE):
                ids, ends = known.column(part.column(1).fill_null("").cast(pa.string()))
                for doc_id, a, b in zip(part.column(0).to_pylist(), ends.tolist(), ends[1:].tolist(), strict=False):
                    whole = ids[a:b].tobytes() + closing
                    for piece, at in enumerate(range(0, len(whole), 4 * capacity)):
                        cut = whole[at : at + 4 * capacity]
                        length = len(cut) // 4
                        placed.append((doc_id, piece, at // 4, length, zlib.crc32(cut), *bins.place(length)))
                if len(placed) >= ROWS:
                    yield out()
        if placed:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
