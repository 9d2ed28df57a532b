"""Quality rules: robust multivariate outliers (operator 1).

Each document gives a vector of transformed statistics. For each (language, source), each language and the whole
corpus the minimum covariance determinant is sought: the mean and covariance of the `support` share of documents
whose covariance has the least determinant. Three deterministic starts are taken (medians with quartile scales alone,
with the correlations of the scaled values' hyperbolic tangents, and with those of their spatial signs). A
concentration step takes the share of documents nearest to an estimate and estimates from them, which never raises the
determinant; after two steps of all starts each group goes on with the start of the least one, until no group's
determinant falls any more. All documents take part in every step, as map-side combined integer sums; only one row a
group and start is ever joined back.

A group's estimate is drawn towards its language's, and that towards the corpus's, as if `prior_rows` documents of the
wider one were added: small groups lean on it, and no group is left out. Documents farther than the chi-square bound
are rejected.

Defined cases: a null text has no words and fails the base rule; null lang or source is a group of its own; a group of
one usable document has its language's estimate nearly; where no document passes the base rule nothing has a distance;
equal distances at the share's edge all count as near; repeated rows are judged like single ones; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.llm.words import SPACE, Words, apart, chunks
from inkspark.sources.shared import forget, written

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")
#: The vector's parts and the least standard deviation that each is taken to have: shares are nearly constant in
#: clean text, and without a floor the covariance of a degenerate group could not be inverted.
PARTS = {"t_length": 0.06, "t_symbols": 0.05, "t_marks": 0.05, "t_upper": 0.05, "t_dup_lines": 0.12, "t_repeats": 0.10}
UNIT = 10_000  # vectors are integers of 1/UNIT, so sums don't depend on the order of rows


@dataclass(frozen=True)
class OutlierRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    support: float = 0.75  # share of a group's documents that gives mean and covariance
    steps: int = 20  # concentration steps at most; those after the second stop once no determinant falls
    prior_rows: float = 40.0  # documents' weight of the wider group's estimate
    tail: float = 1e-7  # share of clean documents that the bound may reject


_SYMBOL, _UPPER, _DIGIT, _MARK, _HEAD = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[33:127] = True
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = False
_HEAD[:128] = _HEAD[192:] = True  # bytes that begin a code point
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    w = Words(data, offsets)
    out = {"n_words": w.counts, "word_chars": _per_row(_HEAD[data] & ~SPACE[data], offsets)}
    for name, flag in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_marks", _MARK), ("n_digits", _DIGIT)):
        out[name] = _per_row(flag[data], offsets)

    # A line ends at a break or with its row; lines without a word don't count.
    starts = np.union1d(np.flatnonzero(_LINE[data]) + 1, offsets[:-1])
    ends = np.append(starts[1:], len(data))
    line, at = np.unique(np.searchsorted(starts, w.start, "right") - 1, return_index=True)
    row, start, end = w.row[at], starts[line], ends[line]
    end = end - ((end > start) & _LINE[data[np.maximum(end - 1, 0)]])
    same = _repeats(row, w.spans(start, end))[1]
    out["n_dup_lines"] = np.bincount(row[same], minlength=rows)
    out["n_lines"] = np.bincount(row, minlength=rows)

    grams, first = w.shingles(w.hashes(), 3)
    again = first[_repeats(w.row[first], grams)[0]]
    covered = np.zeros(len(w.start), bool)
    for j in range(3):
        covered[again + j] = True
    out["n_repeat_words"] = np.bincount(w.row[covered], minlength=rows)
    return out


def _repeats(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items in order: whether the row holds the key twice or more, and whether it held it before."""
    order = np.lexsort((key, row))  # stable: equal items stay in order
    same = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    many, later = np.zeros(len(row), bool), np.zeros(len(row), bool)
    later[order[1:][same]] = True
    many[order[1:][same]] = many[order[:-1][same]] = True
    return many, later


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_key (a hash of the text) and STATS of each row of `docs`."""
    ids = docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_key"), "text")
    schema = f"{ids.drop('text').schema.simpleString()[7:-1]}, {', '.join(f'{s}:bigint' for s in STATS)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            found = text_statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(found[s], pa.int64()) for s in STATS)], names=[*batch.schema.names[:4], *STATS])

    return ids.mapInArrow(run, schema)


def _fixed(x: Column) -> Column:
    return F.round(x * UNIT).cast("long")


def _share(part: str, whole: str) -> Column:
    return F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))


def vectors(stats: DataFrame) -> DataFrame:
    return stats.withColumns({
        "t_length": _fixed(F.log((F.col("word_chars") + 500) / (F.col("n_words") + 100))),
        "t_symbols": _fixed(_share("n_symbols", "word_chars")),
        "t_marks": _fixed(_share("n_marks", "word_chars")),
        "t_upper": _fixed(_share("n_upper", "word_chars")),
        "t_dup_lines": _fixed(_share("n_dup_lines", "n_lines")),
        "t_repeats": _fixed(_share("n_repeat_words", "n_words")),
    })


def chi2_cdf(x: float, k: int) -> float:
    """For even k."""
    term = total = 1.0
    for j in range(1, k // 2):
        term *= x / 2 / j
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


_NAMES = list(PARTS)
_DIM = len(_NAMES)
_PAIRS = [(i, j) for i in range(_DIM) for j in range(i, _DIM)]
_FLOOR = np.diag([v * v for v in PARTS.values()])
_ESTIMATE = "n long, mean array<double>, cov array<double>, inverse array<double>, log_det double"
LEVELS = {"source": ("lang", "source"), "lang": ("lang",), "all": ()}


def level_key(level: str) -> Column:
    return F.to_json(F.struct(F.lit(level).alias("level"), *(F.col(c) for c in LEVELS[level])))


def _full(upper: np.ndarray) -> np.ndarray:
    out = np.zeros((_DIM, _DIM))
    for (i, j), v in zip(_PAIRS, upper, strict=True):
        out[i, j] = out[j, i] = v
    return out


def _upper(full: np.ndarray) -> list[float]:
    return [float(full[i, j]) for i, j in _PAIRS]


def _estimate(n: int, mean: np.ndarray, cov: np.ndarray) -> tuple:
    """With the floors on the diagonal for the inverse and the determinant; cov is kept without them."""
    held = cov + _FLOOR
    inverse = np.linalg.inv(held)
    double = [float(inverse[i, j] * (1 if i == j else 2)) for i, j in _PAIRS]
    return int(n), mean.tolist(), _upper(cov), double, float(np.linalg.slogdet(held)[1])


def _from_sums(rows: Iterator[pd.DataFrame], factor: float) -> Iterator[pd.DataFrame]:
    """Estimates from integer sums of the central share."""
    for frame in rows:
        out = []
        for r in frame.itertuples(index=False):
            mean = np.array(r.sums, float) / r.n
            cov = (_full(np.array(r.products, float) / r.n) - np.outer(mean, mean)) / UNIT**2 * (factor if r.n < r.members else 1.0)
            out.append((r.level, r.start, int(r.members), *_estimate(r.n, mean / UNIT, cov)))
        yield pd.DataFrame(out, columns=["level", "start", "members", "n", "mean", "cov", "inverse", "log_det"])


def _from_starts(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The three first estimates of each level."""
    for frame in rows:
        out = []
        for r in frame.itertuples(index=False):
            center, scale = np.array(r.center, float) / UNIT, np.array(r.scale, float)
            at = np.array(r.tanh_mean, float) / r.members
            tanh = _full(np.array(r.tanh, float) / r.members) - np.outer(at, at)
            for start, shape in enumerate((np.eye(_DIM), tanh, _full(np.array(r.signs, float)))):
                size = np.sqrt(np.maximum(np.diag(shape), 1e-12))
                correlation = shape / np.outer(size, size)
                # A part that never varies goes with no other, and no shape is taken as flat.
                correlation[np.diag(shape) <= 1e-12] = 0
                correlation[:, np.diag(shape) <= 1e-12] = 0
                np.fill_diagonal(correlation, 1.0)
                out.append((r.level, start, int(r.members), *_estimate(r.members, center, 0.95 * correlation * np.outer(scale, scale) + 0.05 * np.diag(scale**2))))
        yield pd.DataFrame(out, columns=["level", "start", "members", "n", "mean", "cov", "inverse", "log_det"])


_STEP = f"level string, start int, members long, {_ESTIMATE}"


def consistency(support: float) -> float:
    """What the covariance of the central share is short of the whole's, for normal data."""
    return support / chi2_cdf(chi2_quantile(support, _DIM), _DIM + 2)


def distance(parts: list[Column], mean: Column, inverse: Column) -> Column:
    off = [p / UNIT - mean[i] for i, p in enumerate(parts)]
    return sum((off[i] * off[j] * inverse[k] for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0))


def _started(levels: DataFrame) -> DataFrame:
    cols = [F.col(c) for c in _NAMES]
    quart = [F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for c in cols]
    at = levels.groupBy("level").agg(F.count(F.lit(1)).alias("members"), *(q.alias(f"q{i}") for i, q in enumerate(quart)))
    scale = F.array(*(F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / (1.349 * UNIT), F.lit(f)) for i, f in enumerate(PARTS.values())))
    at = written(at.select("level", "members", F.array(*(F.col(f"q{i}")[1] for i in range(_DIM))).alias("center"), scale.alias("scale")), "mcd-centers")
    z = [(c - F.col("center")[i]) / (UNIT * F.col("scale")[i]) for i, c in enumerate(cols)]
    met = levels.join(at, "level").select("level", "members", "center", "scale", *(x.alias(f"z{i}") for i, x in enumerate(z)))
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(_DIM)), F.lit(0.0)))
    met = met.withColumn("norm", norm).select("level", "members", "center", "scale", *(F.tanh(f"z{i}").alias(f"t{i}") for i in range(_DIM)), *(F.when(F.col("norm") > 0, F.col(f"z{i}") / F.col("norm")).otherwise(0.0).alias(f"s{i}") for i in range(_DIM)))
    # Sums of values on a grid don't depend on the order of rows.
    total = lambda x: F.sum(F.round(x * 1_000_000).cast("long")) / 1e6
    sums = met.groupBy("level").agg(
        F.first("members").alias("members"), F.first("center").alias("center"), F.first("scale").alias("scale"),
        F.array(*(total(F.col(f"t{i}")) for i in range(_DIM))).alias("tanh_mean"),
        F.array(*(total(F.col(f"t{i}") * F.col(f"t{j}")) for i, j in _PAIRS)).alias("tanh"),
        F.array(*(total(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in _PAIRS)).alias("signs"),
    )
    out = written(sums.mapInPandas(_from_starts, _STEP), "mcd")
    forget(at)
    return out


def _stepped(levels: DataFrame, params: DataFrame, support: float) -> DataFrame:
    """One concentration step of each level and start."""
    cols = [F.col(c) for c in _NAMES]
    # Distances on a grid of 0.1 %: an exact quantile of a bounded number of values, the same in any order.
    near = levels.join(params.select("level", "start", "members", "mean", "inverse"), "level").withColumn("d", F.round(1000 * F.log1p(distance(cols, F.col("mean"), F.col("inverse")))).cast("long"))
    # A written table has a size that is known: it is broadcast only where it is small.
    bound = written(near.groupBy("level", "start").agg(F.percentile("d", F.lit(support)).alias("bound")), "mcd-bound")
    central = near.join(bound, ["level", "start"]).filter(F.col("d") <= F.ceil("bound"))
    sums = central.groupBy("level", "start").agg(F.first("members").alias("members"), F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)), *(F.sum(cols[i] * cols[j]).alias(f"p{k}") for k, (i, j) in enumerate(_PAIRS)))
    shaped = sums.select("level", "start", "members", "n", F.array(*(F.col(f"s{i}").cast("double") for i in range(_DIM))).alias("sums"), F.array(*(F.col(f"p{k}").cast("double") for k in range(len(_PAIRS)))).alias("products"))
    factor = consistency(support)
    out = written(shaped.mapInPandas(lambda rows: _from_sums(rows, factor), _STEP), "mcd")
    forget(bound)
    return out


def estimated(vecs: DataFrame, rules: OutlierRules) -> DataFrame:
    """level, n, mean, cov, inverse, log_det: the minimum covariance determinant of each group of each level."""
    levels = vecs.select(F.explode(F.array(*map(level_key, LEVELS))).alias("level"), *_NAMES)
    params = _started(levels)
    for _ in range(min(2, rules.steps)):
        old, params = params, _stepped(levels, params, rules.support)
        forget(old)
    # Equal determinants: the first start.
    best = params.groupBy("level").agg(F.min_by(F.struct(*(c for c in params.columns if c != "level")), F.struct("log_det", "start")).alias("b")).select("level", "b.*")
    params = written(best, "mcd")
    for _ in range(rules.steps - 2):
        now = _stepped(levels, params, rules.support)
        # A step off the grid's edge may raise a determinant by a trace: the lower one stays.
        both = now.select("level", F.struct(*(c for c in now.columns if c != "level")).alias("now")).join(params.select("level", F.struct(*(c for c in now.columns if c != "level")).alias("was")), "level")
        kept = written(both.select("level", F.when(F.col("now.log_det") < F.col("was.log_det"), F.col("now")).otherwise(F.col("was")).alias("b"), (F.col("was.log_det") - F.col("now.log_det")).alias("fell")), "mcd")
        fell = kept.agg(F.max("fell")).first()[0]
        for done in (params, now):
            forget(done)
        params = kept.select("level", "b.*")
        if fell is None or fell < 1e-3:
            break
    return params


def _drawn(rows: Iterator[pd.DataFrame], prior: float) -> Iterator[pd.DataFrame]:
    """Each source's estimate, drawn towards its language's, and that towards the corpus's."""
    def towards(n: int, mean: np.ndarray, cov: np.ndarray, wide_mean: np.ndarray, wide_cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = n / (n + prior)
        off = mean - wide_mean
        return own * mean + (1 - own) * wide_mean, own * cov + (1 - own) * wide_cov + own * (1 - own) * np.outer(off, off)

    for frame in rows:
        out = []
        for r in frame.itertuples(index=False):
            lang = towards(r.lang_members, np.array(r.lang_mean), _full(r.lang_cov), np.array(r.all_mean), _full(r.all_cov))
            mean, cov = towards(r.members, np.array(r.mean), _full(r.cov), *lang)
            n, mean, _, inverse, _ = _estimate(r.members, mean, cov)
            out.append((r.level, n, mean, inverse))
        yield pd.DataFrame(out, columns=["level", "n", "mean", "inverse"])


def fitted(vecs: DataFrame, rules: OutlierRules) -> DataFrame:
    """level, n, mean, inverse of each (language, source)."""
    params = estimated(vecs, rules)
    groups = vecs.select("lang", "source").distinct().select(level_key("source").alias("level"), level_key("lang").alias("by_lang"))
    wide = lambda name: params.select(F.col("level").alias(f"by_{name}"), F.col("members").alias(f"{name}_members"), F.col("mean").alias(f"{name}_mean"), F.col("cov").alias(f"{name}_cov"))
    every = wide("all").filter(F.col("by_all") == level_key("all")).drop("by_all")
    met = groups.join(params.select("level", "members", "mean", "cov"), "level").join(wide("lang"), "by_lang").crossJoin(F.broadcast(every))
    return written(met.mapInPandas(lambda rows: _drawn(rows, rules.prior_rows), "level string, n long, mean array<double>, inverse array<double>"), "mcd-drawn")


def judged(docs: DataFrame, rules: OutlierRules = OutlierRules()) -> DataFrame:
    """A row for each row of `docs`: its statistics, base_failed, distance2, the level that judged it, and kept."""
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    vecs = written(vectors(statistics(docs)).withColumn("base_failed", base), "quality")
    params = fitted(vecs.filter(~F.col("base_failed")), rules)
    bound = chi2_quantile(1 - rules.tail, _DIM)
    both = vecs.withColumn("level", level_key("source")).join(params, "level", "left")
    far = both.withColumn("distance2", F.round(distance([F.col(c) for c in _NAMES], F.col("mean"), F.col("inverse")), 6))
    kept = ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= bound)
    return far.withColumn("kept", kept).select("doc_id", "text_key", *STATS, "base_failed", "kept", "distance2", "level")


def kept_documents(docs: DataFrame, rules: OutlierRules = OutlierRules()) -> DataFrame:
    """The rows of `docs` that pass, with all their columns, whatever their names."""
    i, k = apart(docs, "id", "key")
    gone = judged(docs, rules).filter(~F.col("kept")).select(F.col("doc_id").alias(i), F.col("text_key").alias(k)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[i]) & (F.xxhash64(docs["text"]) == gone[k]), "left_anti")
