"""Plain forms of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import xxhash

SPLIT = r"[\x20\x09-\x0D]+"


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [w for w in re.split(SPLIT, text) if w]


def statistics(text: str | None) -> tuple:
    w = words(text)
    seen, dup = set(), 0
    lines = [line for line in (text or "").split("\n") if words(line)]
    for line in lines:
        dup += line in seen
        seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def one_edit(a: tuple, b: tuple) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def dropped(docs: list[tuple], least: int = 5) -> set[tuple[int, int]]:
    lines = [((i, k), tuple(words(line))) for i, t in docs if t is not None for k, line in enumerate(t.split("\n")) if words(line)]
    first: dict = {}
    for place, w in sorted(set(lines)):
        first.setdefault(w, place)
    near = {w for w, p in first.items() if len(w) >= least and any(q < p and len(v) >= least and abs(len(v) - len(w)) < 2 and one_edit(w, v) for v, q in first.items())}
    return {p for p, w in lines if p != first[w] or w in near}


def fingerprint(text: str | None) -> int:
    w = words(text, lower=True)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(codes: np.ndarray, distance: int = 4) -> list[int]:
    """The least index that each can reach."""
    root = list(range(len(codes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= distance) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def shingles(text: str | None) -> set[tuple]:
    w = re.sub(rb"[^0-9A-Za-z\x80-\xff]+", b" ", (text or "").encode()).lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def secrets(text: str | None) -> tuple[tuple, str]:
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, "assign", m.end())] * (len(m[2]) >= 8)
    for order, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 16), (2, "hex", "[0-9a-f]+", 32)):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))
    return tuple(sum(o[1] == i for o in out) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest()


def luhn(digits: str) -> bool:
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def personal(text: str | None) -> tuple[tuple, str]:
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    for order, (kind, pattern, fit) in enumerate(tests):
        out += [(order, m.start(), m.end(), kind) for m in re.finditer(pattern, text) if fit(m)]
    joined = ",".join(f"{k}:{a}:{b}" for _, a, b, k in sorted(out))
    return tuple(sum(o[0] == i for o in out) for i in range(4)), hashlib.sha256(joined.encode()).hexdigest()


def best_fit(lengths: list[int], capacity: int, most: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece in turn: the open sequence with the least free space that fits, of equal ones
    the one touched last; beyond `most` open ones the fullest is closed."""
    open_: list[list[int]] = []  # sequence, used; in the order of touches
    out, number = [], 0
    for n in lengths:
        fit = [o for o in open_ if capacity - o[1] >= n]
        if fit:
            used = max(o[1] for o in fit)
            at = [o for o in fit if o[1] == used][-1]
            open_.remove(at)
        else:
            if len(open_) == most:
                fullest = max(o[1] for o in open_)
                open_.remove([o for o in open_ if o[1] == fullest][-1])
            at, number = [number, 0], number + 1
        out.append((at[0], at[1]))
        at[1] += n
        if at[1] < capacity:
            open_.append(at)
    return out


def best_split(name: str, counts: dict[str, int]) -> float:
    """The score of the best way to cut a name into words, over all ways."""
    total = max(sum(counts.values()), 1)
    cost = lambda w: max(np.log10(counts[w] / total) if w in counts else -np.inf, 1 - np.log10(total) - len(w))
    best = [0.0]
    for end in range(1, len(name) + 1):
        best.append(max(best[a] + cost(name[a:end]) for a in range(end)))
    return best[-1]
