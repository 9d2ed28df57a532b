"""Token counts (operator 4): edit-aware counting with a segment tree over pre-token runs.

A text is cut into leaves where white space follows a printing character: no pre-token of the byte-level tokenizer
spans such a place, so a text's tokens are those of its leaves. The tree is kept with its document: the leaves' texts,
and heaps of the sums of their characters and tokens. An edit is found by descending the character sums; only the
leaves it touches are cut and encoded again, with the neighbours whose boundary it makes unsafe, and the sums above
them are updated. Where the region needs more leaves than it has, the heaps are built again from the leaves' numbers,
with nothing encoded: that happens once for each leaf's worth of characters put in at most.

Defined cases: a null or empty text has one empty leaf and no tokens; repeated rows are counted each; a text
without a place to cut is one leaf, however long; edits beyond the text's end are cut to it; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LEAF = 128  # characters from which a leaf ends at the next safe place
SAFE = re.compile(r"[!-~](?=[ \n])")


def leaves_of(text: str, leaf: int = LEAF) -> list[str]:
    out, at = [], 0
    while cut := SAFE.search(text, at + leaf - 1):
        out.append(text[at : cut.end()])
        at = cut.end()
    return [*out, text[at:]]


def _heap(values: list[int]) -> list[int]:
    size = 1 << max(0, (len(values) - 1).bit_length())
    out = [0] * size + values + [0] * (size - len(values))
    for i in range(size - 1, 0, -1):
        out[i] = out[2 * i] + out[2 * i + 1]
    return out


class TokenTree:
    """Leaves' texts, and their characters and tokens under sums, as implicit heaps."""

    def __init__(self, parts: list[str], chars: list[int], tokens: list[int], leaf: int = LEAF):
        self.parts, self.chars, self.tokens, self.leaf = parts, chars, tokens, leaf

    @classmethod
    def of(cls, text: str, count: Callable[[str], int], leaf: int = LEAF) -> TokenTree:
        parts = leaves_of(text, leaf)
        return cls(parts, _heap([len(p) for p in parts]), _heap([count(p) if p else 0 for p in parts]), leaf)

    @property
    def size(self) -> int:
        return len(self.chars) // 2

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def find(self, position: int) -> tuple[int, int]:
        """The leaf with a character (the last one with any at the text's end), and where the leaf starts."""
        i, start = 1, 0
        position = min(position, self.chars[1] - 1)
        while i < self.size:
            i *= 2
            if position - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def _put(self, leaf: int, text: str, count: Callable[[str], int]) -> None:
        self.parts[leaf] = text
        i = leaf + self.size
        more, extra = len(text) - self.chars[i], (count(text) if text else 0) - self.tokens[i]
        while i:
            self.chars[i] += more
            self.tokens[i] += extra
            i //= 2

    def edit(self, start: int, end: int, new: str, count: Callable[[str], int]) -> int:
        """Makes the edit; how many characters were encoded again."""
        length = self.chars[1]
        start = min(max(start, 0), length)
        end = min(max(end, start), length)
        first, left = self.find(max(start - 1, 0))
        last, at = self.find(end)
        right = at + self.chars[last + self.size]
        old = "".join(self.parts[first : last + 1])
        region = old[: start - left] + new + old[end - left :]
        # Both bounds must be safe in the new text, or the region takes in the next leaf with text.
        while left > 0 and not self._safe(self._char(left - 1), region[:1]):
            first, left = self.find(left - 1)
            region = self.parts[first] + region
        while right < length and not self._safe(region[-1:] or (self._char(left - 1) if left else ""), self._char(right)):
            last, at = self.find(right)
            region += self.parts[last]
            right = at + self.chars[last + self.size]
        slots, parts = last + 1 - first, leaves_of(region, self.leaf)
        if len(parts) <= slots:
            for k in range(slots):
                self._put(first + k, parts[k] if k < len(parts) else "", count)
        else:
            chars, tokens = (h[self.size : self.size + len(self.parts)] for h in (self.chars, self.tokens))
            chars[first : last + 1] = map(len, parts)
            tokens[first : last + 1] = [count(p) if p else 0 for p in parts]
            self.parts[first : last + 1] = parts
            self.chars, self.tokens = _heap(chars), _heap(tokens)
        return len(region)

    def _char(self, position: int) -> str:
        leaf, start = self.find(position)
        return self.parts[leaf][position - start]

    @staticmethod
    def _safe(before: str, after: str) -> bool:
        return "!" <= before <= "~" and after in (" ", "\n")


_counters: dict[str, Callable[[str], int]] = {}


def counter(file: str) -> Callable[[str], int]:
    """Counts a text's tokens; one for each Python worker and vocabulary."""
    if file not in _counters:
        import public_tokenizers
        import tiktoken

        with open(file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _counters[file] = lambda text: len(encode(text))
    return _counters[file]


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


STATE = "parts array<string>, chars array<int>, tokens array<int>"


def _mapped(df: DataFrame, columns: list[str], schema: str, row: Callable[..., tuple], file: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(file)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rest = [part.column(i).to_pylist() for i in range(1, part.num_columns)]
                cols = list(zip(*(row(count, *x) for x in zip(*rest, strict=True)), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

    kind = df.schema["doc_id"].dataType.simpleString()
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    types = {"long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    names, kinds = ["doc_id", *(f[0] for f in fields)], [types[f[1]] for f in fields]
    return df.select("doc_id", *columns).mapInArrow(run, f"doc_id {kind}, {schema}")


def built(docs: DataFrame, file: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, parts (the leaves' texts, whose concatenation is the text), chars and tokens (the heaps), n_tokens."""
    def row(count: Callable[[str], int], text: str | None) -> tuple:
        tree = TokenTree.of(text or "", count, leaf)
        return tree.parts, tree.chars, tree.tokens, tree.total

    return _mapped(docs, ["text"], f"{STATE}, n_tokens long", row, file or vocabulary_file())


def edited(state: DataFrame, file: str | None = None, leaf: int = LEAF) -> DataFrame:
    """`built` rows after their `edits` (array of start, end, new; each in the text that the one before left; null:
    none): the same columns, and n_before and n_encoded, the characters that were encoded again."""
    def row(count: Callable[[str], int], parts: list[str], chars: list[int], tokens: list[int], edits: list[dict] | None) -> tuple:
        tree = TokenTree(parts, chars, tokens, leaf)
        before = tree.total
        again = sum(tree.edit(e["start"], e["end"], e["new"], count) for e in edits or [])
        return tree.parts, tree.chars, tree.tokens, tree.total, before, again

    return _mapped(state, ["parts", "chars", "tokens", "edits"], f"{STATE}, n_tokens long, n_before long, n_encoded long", row, file or vocabulary_file())
