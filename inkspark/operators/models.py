"""Smoothed language models as joins of n-gram tables: no probability table is ever gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions import text as tx
from inkspark.operators import ngrams


def positions(rows: DataFrame, order: int, keys: tuple[str, ...], text: str = "text", left: str | None = None) -> DataFrame:
    """keys, i and the grams g1..g<order> that end at each token (the end mark is not scored); left: the column with
    what stands before the text."""
    before = F.array_repeat(F.lit(tx.BEGIN), order - 1) if left is None else F.concat(F.array_repeat(F.lit(tx.BEGIN), order - 1), tx.tokens(F.coalesce(left, F.lit(""))))
    own = F.concat(F.slice(before, F.size(before) - order + 2, F.lit(order - 1)) if left is not None and order > 1 else before, tx.tokens(text), F.array(F.lit(tx.END)))
    padded = rows.select(*keys, own.alias("t"))
    at = padded.withColumn("i", F.explode(F.expr(f"filter(sequence({order}, greatest(size(t), {order})), i -> i < size(t))")))
    return at.select(*keys, "i", *(F.array_join(F.slice("t", F.col("i") - n + 1, F.lit(n)), "").alias(f"g{n}") for n in range(1, order + 1)))


def _with_tables(grams: DataFrame, tables: dict[int, DataFrame], follow: dict[int, DataFrame], order: int) -> DataFrame:
    out = grams
    for n in range(1, order + 1):
        out = out.join(tables[n].select(F.col("gram").alias(f"g{n}"), F.col("c").alias(f"c{n}")), f"g{n}", "left")
        if n > 1:
            out = out.withColumn(f"h{n}", F.expr(f"left(g{n}, {n - 1})")).join(follow[n].select(F.col("history").alias(f"h{n}"), F.col("total").alias(f"N{n}"), F.col("types").alias(f"T{n}")), f"h{n}", "left")
    return out


def _distinct(pos: DataFrame, order: int) -> DataFrame:
    return pos.select(*(f"g{n}" for n in range(1, order + 1))).distinct()


def vocabulary(counts: DataFrame, characters: DataFrame) -> int:
    """How many different tokens the counts and `characters` (char) have together."""
    return counts.filter("n = 1").select("gram").union(characters.select("char")).distinct().count()


def witten_bell(pos: DataFrame, counts: DataFrame, vocabulary_size: int | None = None, order: int = 3, least: int = 2) -> DataFrame:
    """`pos` with p: each distinct gram's probability is found once and joined back. The vocabulary is that of the
    counts where no size is given; a smaller one is an error."""
    sums = counts.filter("n = 1").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("V"))
    if vocabulary_size is not None:
        sums = sums.select("total", F.when(F.col("V") > vocabulary_size, F.raise_error(F.lit("the vocabulary is smaller than the types seen"))).otherwise(F.lit(vocabulary_size)).cast("long").alias("V"))
    follow = ngrams.followers(counts)
    kept = ngrams.pruned(counts, least, order)
    met = _with_tables(_distinct(pos, order), {n: kept.filter(F.col("n") == n) for n in range(1, order + 1)}, {n: follow for n in range(2, order + 1)}, order).crossJoin(F.broadcast(sums))
    c = lambda n: F.coalesce(f"c{n}", F.lit(0))
    p: Column = (c(1) + 1) / (F.col("total") + F.col("V")).cast("double")
    for n in range(2, order + 1):
        p = F.when(F.col(f"N{n}").isNull(), p).otherwise((c(n) + F.col(f"T{n}") * p) / (F.col(f"N{n}") + F.col(f"T{n}")).cast("double"))
    return pos.join(met.select(f"g{order}", p.alias("p")), f"g{order}")


def kneser_ney(pos: DataFrame, counts: DataFrame, order: int = 3, discount: float = 0.75) -> DataFrame:
    """`pos` with p of interpolated Kneser-Ney: raw counts at the top order, left types below."""
    cont = ngrams.continuation(counts)
    cont_follow = cont.filter("n > 1").groupBy(F.expr("left(gram, n - 1)").alias("history")).agg(F.sum("left_types").alias("total"), F.count(F.lit(1)).alias("types"))
    tables = {n: (counts.filter(F.col("n") == n) if n == order else cont.filter(F.col("n") == n).withColumnRenamed("left_types", "c")) for n in range(1, order + 1)}
    follow = {n: ngrams.followers(counts.filter(F.col("n") == order)) if n == order else cont_follow for n in range(2, order + 1)}
    sums = cont.filter("n = 1").agg(F.sum("left_types").alias("U"), F.count(F.lit(1)).alias("UT")).crossJoin(counts.filter("n = 1").agg(F.count(F.lit(1)).alias("V")))
    met = _with_tables(_distinct(pos, order), tables, follow, order).crossJoin(F.broadcast(sums))
    less = lambda n: F.greatest(F.coalesce(f"c{n}", F.lit(0)) - discount, F.lit(0.0))
    p: Column = (less(1) + discount * F.col("UT") / F.col("V")) / F.col("U")
    for n in range(2, order + 1):
        p = F.when(F.col(f"N{n}").isNull(), p).otherwise((less(n) + discount * F.col(f"T{n}") * p) / F.col(f"N{n}"))
    return pos.join(met.select(f"g{order}", p.alias("p")), f"g{order}")


def log_score(scored: DataFrame, keys: tuple[str, ...], p: str = "p") -> DataFrame:
    """keys, n_tokens, log10 probability and bits per token."""
    out = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(F.log10(p)).alias("log10_p"))
    return out.withColumn("bits_per_token", -F.col("log10_p") / F.col("n_tokens") * F.lit(3.321928094887362))


def mixed(parts: list[tuple[DataFrame, float]], keys: tuple[str, ...]) -> DataFrame:
    """keys, i, p: the weighted sum of models' probabilities (not of their logarithms)."""
    if abs(sum(w for _, w in parts) - 1) > 1e-9 or any(w < 0 for _, w in parts):
        raise ValueError("weights must be non-negative and sum to 1")
    out = None
    for df, w in parts:
        one = df.select(*keys, "i", (F.col("p") * w).alias("p"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*keys, "i").agg(F.sum("p").alias("p"))


#: Weights of the everyday mixture of domains.
GENERAL = {"government_faq": 0.3, "public_service": 0.3, "press_release": 0.3, "legal": 0.1}


def interpolated(pos: DataFrame, tables: dict[str, DataFrame], weights: dict[str, float], keys: tuple[str, ...], vocabulary_size: int | None = None, order: int = 3) -> DataFrame:
    """keys, i, p of the domains' models mixed by their weights; a weighted domain without a table is an error."""
    lacking = [d for d, w in weights.items() if w > 0 and d not in tables]
    if lacking:
        raise ValueError(f"no counts for {lacking}")
    return mixed([(witten_bell(pos, tables[d], vocabulary_size, order), w) for d, w in weights.items() if w > 0], keys)


def corpus_counts(sentences: DataFrame, configuration: str, domain: str = "domain", text: str = "text", cap: int = 20_000) -> DataFrame:
    """n-gram counts of a configuration: raw (all sentences), capped (the first `cap` of each domain by hash), or
    domain (by domain)."""
    from inkspark.operators import corpus

    if configuration == "raw":
        return ngrams.counted(sentences, text=text)
    if configuration == "capped":
        return ngrams.counted(corpus.capped(sentences.select(domain, text), domain, text, cap), text=text)
    if configuration == "domain":
        return ngrams.counted(sentences, text=text, by=(domain,))
    raise ValueError(f"no configuration {configuration}")
