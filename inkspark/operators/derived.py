"""Derived lexicons: slice tables, estimators, candidate statistics, filters, priors and recipes.

Sentences are rows (slice, source, doc, text); one slice is the everyday one, the others are weighted. Counts are
aggregated by slice and gram and everything else is joined to them by gram: nothing is gathered but short lists of
slices and sources for each word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions import text as tx
from inkspark.operators import lexicons, ngrams
from inkspark.sources.shared import written

#: Numerals beside which a gram is part of a template; thresholds of candidates and filters.
NUMERALS = "〇零一二三四五六七八九十百千萬兩0123456789０１２３４５６７８９"
PER_MILLION, EVERYDAY_LEAST, EVERYDAY_WEIGHT = 2.0, 3, 0.25


def slice_counts(sentences: DataFrame, script: str = "han", longest: int = 4, least: int = 2) -> DataFrame:
    """slice, n, gram, c of runs of the script; longer grams than one character only from `least` on."""
    counts = ngrams.run_grams(sentences, tuple(range(1, longest + 1)), script=script, by=("slice",))
    return counts.filter((F.col("n") == 1) | (F.col("c") >= least))


def pooled(counts: DataFrame, everyday: str, weights: dict[str, float]) -> DataFrame:
    """n, gram, pooled and everyday counts, pooled_p, everyday_p and weighted_p (the weighted sum of the other slices'
    rates), for the slices that have a weight and the everyday one."""
    counts = counts.filter(F.col("slice").isin(everyday, *weights))
    totals = counts.filter("n = 1").groupBy("slice").agg(F.sum("c").alias("total"))
    weight = F.coalesce(*(F.when(F.col("slice") == s, F.lit(w)) for s, w in weights.items()), F.lit(0.0))
    own = F.col("slice") == everyday
    # Few slices: their totals are broadcast.
    met = counts.join(F.broadcast(totals), "slice")
    by_gram = met.groupBy("n", "gram").agg(F.sum("c").alias("pooled"), F.sum(F.when(own, F.col("c")).otherwise(0)).alias("everyday"), F.sum(weight * F.col("c") / F.col("total")).alias("weighted_p"))
    sums = totals.agg(F.sum("total").alias("a"), F.sum(F.when(own, F.col("total"))).alias("b"))
    rate = lambda c, of: F.coalesce(F.col(c) / F.nullif(F.col(of), F.lit(0)), F.lit(0.0))
    return by_gram.crossJoin(F.broadcast(sums)).select("n", "gram", "pooled", "everyday", rate("pooled", "a").alias("pooled_p"), rate("everyday", "b").alias("everyday_p"), "weighted_p")


def interpolated(weight: float = EVERYDAY_WEIGHT) -> Column:
    return weight * F.col("everyday_p") + (1 - weight) * F.col("weighted_p")


def cut_pmi(table: DataFrame, wanted: DataFrame, p: Column, name: str) -> DataFrame:
    """gram and the least log2 ratio over the two-part cuts of each wanted gram; minus infinity where any part has no p."""
    known = table.select("gram", p.alias("p")).filter("p > 0")
    cuts = wanted.select("gram", F.explode(F.expr("sequence(1, length(gram) - 1)")).alias("k")).select("gram", F.expr("left(gram, k)").alias("l"), F.expr("substring(gram, k + 1)").alias("r"))
    met = cuts.join(known.select(F.col("gram").alias("l"), F.col("p").alias("pl")), "l", "left").join(known.select(F.col("gram").alias("r"), F.col("p").alias("pr")), "r", "left").join(known, "gram", "left")
    return met.groupBy("gram").agg(F.min(F.coalesce(F.log2(F.col("p") / (F.col("pl") * F.col("pr"))), F.lit(float("-inf")))).alias(name))


def fragment_share(table: DataFrame, count: str, name: str, longest: int = 4) -> DataFrame:
    """gram and its commonest extension's share of it; the longest grams have none."""
    own = table.filter(F.col(count) > 0).select("n", "gram", F.col(count).alias("c"))
    return ngrams.extension_share(own).filter((F.col("n") > 1) & (F.col("n") < longest)).select("gram", F.col("share").alias(name))


def candidates(table: DataFrame, known: DataFrame, per_million: float = PER_MILLION, least: int = EVERYDAY_LEAST) -> DataFrame:
    """Rows of `table` of two characters and more that are common enough and no known word (text)."""
    common = (F.col("pooled_p") >= per_million / 1e6) | (F.col("everyday") >= least)
    return table.filter(F.col("n") > 1).filter(common).join(known.select(F.col("text").alias("gram")), "gram", "left_anti")


def occurrences(sentences: DataFrame, wanted: DataFrame, everyday: str, slices: tuple[str, ...], whole: bool = True, script: str = "han", sizes: tuple[int, ...] = (2, 3, 4), numerals: str = NUMERALS) -> DataFrame:
    """gram, count, documents, everyday_documents, numeral_adjacent, by_slice (a map) and sources (sorted), over the
    sentences of the given slices.

    whole: grams at every place of the text; otherwise only inside runs of the script, where no numeral is looked for.
    Rows are summed by document first, a column for each of the few slices, so a common gram's rows never meet in one
    task and documents' rows are dealt out once.
    """
    own = sentences.filter(F.col("slice").isin(*slices)).select("source", "doc", F.array_position(F.array(*map(F.lit, slices)), F.col("slice")).cast("int").alias("k"), "text")
    keys, longest = ["k", "source", "doc"], max(sizes)
    # One window for each place: a character before it, the longest gram and one after; shorter grams are cut from it.
    cut = own if whole else own.select(*keys, F.explode(tx.runs("text", script)).alias("text"))
    wide = F.concat(F.lit("\n"), "text", F.lit("\n" * longest))
    places = cut.select(*keys, F.length("text").alias("size"), F.posexplode(tx.grams(wide, longest + 2)).alias("i", "w"))
    beside = lambda at: (F.instr(F.lit(numerals), F.substring("w", at, 1)) > 0) if whole else F.lit(False)
    grams = F.array(*(F.when(F.col("i") + n <= F.col("size"), F.struct(F.substring("w", 2, n).alias("gram"), (beside(1) | beside(n + 2)).alias("m"))) for n in sizes))
    each = places.select(*keys, F.explode(grams).alias("x")).filter("x is not null").select(*keys, "x.gram", "x.m")
    by = [F.count_if(F.col("k") == i + 1).alias(f"c{i}") for i in range(len(slices))]
    docs = each.join(wanted.select("gram"), "gram", "left_semi").groupBy("gram", "source", "doc").agg(*by, F.count_if("m").alias("m"))
    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(len(slices))]
    per_source = docs.groupBy("gram", "source").agg(*sums, F.sum("m").alias("m"), F.count(F.lit(1)).alias("d"), F.count_if(F.col(f"c{slices.index(everyday)}") > 0).alias("e"))
    totals = per_source.groupBy("gram").agg(*sums, F.sum("d").alias("documents"), F.sum("e").alias("everyday_documents"), F.sum("m").alias("numeral_adjacent"), F.sort_array(F.collect_list("source")).alias("sources"))
    named = F.array(*(F.struct(F.lit(x).alias("slice"), F.col(f"c{i}").alias("c")) for x, i in sorted((x, i) for i, x in enumerate(slices))))
    count = sum((F.col(f"c{i}") for i in range(1, len(slices))), F.col("c0"))
    # Statistics and ratios of slices both start from here.
    return written(totals.select("gram", count.alias("count"), "documents", "everyday_documents", "numeral_adjacent", "sources", F.map_from_entries(F.filter(named, lambda x: x["c"] > 0)).alias("by_slice")), "occurrences")


def statistics(sentences: DataFrame, counts: DataFrame, known: DataFrame, everyday: str, weights: dict[str, float], script: str = "han", longest: int = 4) -> DataFrame:
    """What filters and priors go by, a row for each candidate."""
    table = written(pooled(counts, everyday, weights), "pooled")
    wanted = written(candidates(table, known), "wanted")
    out = wanted.join(cut_pmi(table, wanted, F.col("pooled_p"), "pooled_pmi"), "gram").join(cut_pmi(table, wanted, F.col("everyday_p"), "everyday_pmi"), "gram")
    out = out.join(fragment_share(table, "pooled", "fragment", longest), "gram", "left").join(fragment_share(table, "everyday", "everyday_fragment", longest), "gram", "left")
    sizes = tuple(range(2, longest + 1))
    out = out.join(occurrences(sentences, wanted, everyday, (everyday, *weights), True, script, sizes), "gram", "left").fillna(0.0, ["fragment", "everyday_fragment"]).fillna(0, ["count", "documents", "everyday_documents", "numeral_adjacent"])
    out = out.withColumns({"interpolated_p": interpolated(), "numeral_share": F.when(F.col("count") > 0, F.col("numeral_adjacent") / F.col("count")).otherwise(0.0)})
    totals = counts.filter(F.col("slice").isin(everyday, *weights)).filter("n = 1").groupBy("slice").agg(F.sum("c").alias("total"))
    rates = out.select("gram", F.explode("by_slice").alias("slice", "c")).join(F.broadcast(totals), "slice").withColumn("rate", F.col("c") / F.col("total"))
    top = rates.groupBy("gram").agg(F.min_by("slice", F.struct(-F.col("rate"), "slice")).alias("top_slice"), (F.max("rate") / F.sum("rate")).alias("top_share"))
    return out.join(top, "gram", "left")


def _mixed() -> Column:
    return F.when(F.col("pooled_p") < PER_MILLION / 1e6, "below_pooled_frequency").when(F.col("documents") < 2, "too_few_documents").when(F.col("fragment") >= lexicons.FRAGMENT, "fragment_of_longer_ngram")


def _everyday_only() -> Column:
    return F.when(F.col("everyday") < EVERYDAY_LEAST, "below_everyday_count").when(F.col("everyday_documents") < 3, "too_few_everyday_documents").when(F.col("everyday_pmi") < 3.0, "low_everyday_pmi").when(F.col("everyday_fragment") >= lexicons.FRAGMENT, "fragment_of_longer_ngram")


def filters(everyday: str) -> dict[str, Column]:
    """Why a candidate is left out, by filter; null where it stays."""
    supported = F.when(F.col("everyday_documents") < 2, "no_everyday_support")
    ratio = F.when((F.col("top_slice") != everyday) & (F.col("top_share") >= 0.8), "one_slice_concentrated").when(F.col("numeral_share") >= 0.5, "numeral_template")
    spread = F.when(F.col("documents") < 5, "too_few_documents").when(F.size("sources") < 3, "too_few_sources")
    return {"mixed": _mixed(), "everyday_only": _everyday_only(), "everyday_supported": F.coalesce(_mixed(), supported), "slice_ratio": F.coalesce(_mixed(), ratio), "document_frequency": F.coalesce(_mixed(), spread)}


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("weight", F.lit(lexicons.MEDIAN))


#: Priors by name: each gives `weight`.
PRIORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "flat": _flat, "raw": lambda r: lexicons.ratio_prior(r, "pooled_p"), "log": lambda r: lexicons.log_prior(r, "pooled_p"), "documents": lambda r: lexicons.ratio_prior(r, "documents"),
    "everyday_only": lambda r: lexicons.ratio_prior(r, "everyday_p"), "interpolated": lambda r: lexicons.ratio_prior(r, "interpolated_p"), "rank_bucket": lambda r: lexicons.bucket_prior(r, "pooled_p", "gram"),
}


def judged(stats: DataFrame, readings: DataFrame, filter_: str, everyday: str) -> DataFrame:
    """`stats` with readings (text, readings: array of sequences) and reason, null where the word is kept."""
    met = stats.join(readings.select(F.col("text").alias("gram"), "readings"), "gram", "left")
    return met.withColumn("reason", F.coalesce(filters(everyday)[filter_], F.when(F.col("readings").isNull(), "readings_unresolved")))


def recipe(stats: DataFrame, readings: DataFrame, filter_: str, prior: str, everyday: str) -> DataFrame:
    """text, readings, count, documents, everyday_count, other_count, by_slice, sources, pmi, per_million and weight of
    the words that the filter and the readings leave."""
    kept = PRIORS[prior](judged(stats, readings, filter_, everyday).filter("reason is null"))
    own = F.coalesce(F.try_element_at("by_slice", F.lit(everyday)), F.lit(0))
    return kept.select(F.col("gram").alias("text"), "readings", "count", "documents", own.alias("everyday_count"), (F.col("count") - own).alias("other_count"), "by_slice", "sources", F.round("pooled_pmi", 4).alias("pmi"), F.round(F.col("pooled_p") * 1e6, 4).alias("per_million"), F.round("weight", 4).alias("weight"))


def rejections(stats: DataFrame, readings: DataFrame, filter_: str, everyday: str) -> DataFrame:
    return judged(stats, readings, filter_, everyday).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def extracted(sentences: DataFrame, counts: DataFrame, known: DataFrame, readings: Callable[[DataFrame], DataFrame], everyday: str, weights: dict[str, float], estimator: Column, per_million: float = PER_MILLION, least_documents: int = 2, least_pmi: float = 0.0, script: str = "han", longest: int = 4) -> DataFrame:
    """text, count, documents, pmi, per_million, weight, eligibility of every gram that `estimator` finds frequent:
    eligible, or the first reason against it. readings: texts (text) to (text, readings)."""
    table = written(pooled(counts, everyday, weights), "pooled")
    frequent = written(table.filter(F.col("n") > 1).withColumn("p", estimator).filter(F.col("p") >= per_million / 1e6), "frequent")
    found = occurrences(sentences, frequent, everyday, (everyday, *weights), False, script, tuple(range(2, longest + 1)))
    met = frequent.join(cut_pmi(table, frequent, estimator, "pmi"), "gram").join(fragment_share(table, "pooled", "fragment", longest), "gram", "left").join(found, "gram", "left")
    met = met.join(known.select(F.col("text").alias("gram"), F.lit(True).alias("known")).distinct(), "gram", "left").join(readings(frequent.select(F.col("gram").alias("text"))).select(F.col("text").alias("gram"), "readings"), "gram", "left")
    reason = F.when(F.col("known"), "known_word").when(F.coalesce("documents", F.lit(0)) < least_documents, "too_few_documents").when(F.col("pmi") < least_pmi, "low_pmi").when(F.coalesce("fragment", F.lit(0.0)) >= lexicons.FRAGMENT, "fragment_of_longer_ngram").when(F.col("readings").isNull(), "readings_unresolved").otherwise("eligible")
    out = met.withColumns({"eligibility": reason, "per_million": F.col("p") * 1e6})
    median = out.filter("eligibility = 'eligible'").agg(F.coalesce(F.percentile("per_million", F.lit(0.5)), F.lit(1.0)).alias("median"))
    weight = F.least(F.greatest(lexicons.MEDIAN * F.col("per_million") / F.col("median"), F.lit(lexicons.LEAST)), F.lit(lexicons.MOST))
    return out.crossJoin(F.broadcast(median)).select(F.col("gram").alias("text"), "readings", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("documents", F.lit(0)).alias("documents"), F.round("pmi", 4).alias("pmi"), F.round("per_million", 4).alias("per_million"), F.round(weight, 4).alias("weight"), "eligibility")


def joined_lexicon(base: DataFrame, entries: DataFrame) -> DataFrame:
    """text, reading (joined), frequency: `base` and the derived words it lacks, a word's weight shared by its readings."""
    more = entries.filter(F.size("readings") > 0).select("text", F.explode("readings").alias("r"), (F.col("weight") / F.size("readings")).alias("frequency"))
    more = more.select("text", F.array_join("r", " ").alias("reading"), "frequency").join(base.select("text", "reading"), ["text", "reading"], "left_anti")
    return base.select("text", "reading", "frequency").unionByName(more)


def false_competitors(entries: DataFrame, supported: DataFrame, base: DataFrame) -> DataFrame:
    """unsupported, competing: derived (word, reading) pairs without support (text, readings), and those of them whose
    reading another word of the length has."""
    pairs = entries.select("text", F.explode("readings").alias("r")).select("text", F.array_join("r", " ").alias("reading"))
    fine = supported.select("text", F.explode("readings").alias("r")).select("text", F.array_join("r", " ").alias("reading"))
    bare = pairs.join(fine, ["text", "reading"], "left_anti")
    others = base.select("reading", "text").union(pairs.select("reading", "text")).distinct()
    counts = bare.join(others.select("reading", F.col("text").alias("other")), "reading", "left").groupBy("text", "reading").agg(F.count_if((F.col("other") != F.col("text")) & (F.length("other") == F.length("text"))).alias("rivals"))
    return counts.agg(F.count(F.lit(1)).alias("unsupported"), F.count_if(F.col("rivals") > 0).alias("competing"))


def homophones(entries: DataFrame, base: DataFrame) -> DataFrame:
    """text, reading, competitors, best: how many base words of the length share a derived word's reading, and the
    weightiest of them (then the least text)."""
    pairs = entries.select("text", F.explode("readings").alias("r")).select("text", F.array_join("r", " ").alias("reading"))
    met = pairs.join(base.select("reading", F.col("text").alias("other"), "frequency"), "reading").filter((F.col("other") != F.col("text")) & (F.length("other") == F.length("text")))
    return met.groupBy("text", "reading").agg(F.count(F.lit(1)).alias("competitors"), F.min_by("other", F.struct(-F.col("frequency"), "other")).alias("best"))


def gold_ranks(gold: DataFrame, lexicon: DataFrame) -> DataFrame:
    """gold (word, reading) with contested and rank: its place among the lexicon's words of the reading and length,
    frequency falling, then text; null where the lexicon lacks it."""
    met = gold.join(lexicon.select("reading", F.col("text").alias("other"), "frequency"), "reading", "left").filter("other is null or length(other) = length(word)")
    own = met.groupBy("word", "reading").agg(F.count("other").alias("of"), F.max(F.when(F.col("other") == F.col("word"), F.col("frequency"))).alias("own"))
    ahead = met.join(own, ["word", "reading"]).groupBy("word", "reading").agg(F.first("of").alias("of"), F.first("own").alias("own"), F.count_if((F.col("frequency") > F.col("own")) | ((F.col("frequency") == F.col("own")) & (F.col("other") < F.col("word")))).alias("ahead"))
    return ahead.select("word", "reading", (F.col("of") > 1).alias("contested"), F.when(F.col("own").isNotNull(), F.col("ahead") + 1).alias("rank"))


def with_gold(lexicon: DataFrame, gold: DataFrame, frequency: float = lexicons.MEDIAN) -> DataFrame:
    """A diagnostic upper bound: `lexicon` and the gold (word, reading) pairs that it lacks."""
    lacking = gold.select(F.col("word").alias("text"), "reading").distinct().join(lexicon.select("text", "reading"), ["text", "reading"], "left_anti")
    return lexicon.select("text", "reading", "frequency").unionByName(lacking.withColumn("frequency", F.lit(float(frequency))))


def compared_ranks(ranks: DataFrame, baseline: DataFrame) -> DataFrame:
    """contested, first, mean_rank, better and worse (than the baseline, of words that both contest) of `gold_ranks`."""
    ours = ranks.filter("contested and rank is not null").select("word", "reading", "rank")
    theirs = baseline.filter("contested and rank is not null").select("word", "reading", F.col("rank").alias("was"))
    met = ours.join(theirs, ["word", "reading"], "left")
    return met.agg(F.count(F.lit(1)).alias("contested"), F.count_if(F.col("rank") == 1).alias("first"), F.round(F.avg("rank"), 4).alias("mean_rank"), F.count_if(F.col("rank") < F.col("was")).alias("better"), F.count_if(F.col("rank") > F.col("was")).alias("worse"))


def fixed_words(counts: DataFrame, known: DataFrame, least: int, least_pmi: float, script: str = "han") -> DataFrame:
    """text, c of n-gram counts (n, gram, c) of two and three of the script's characters that stand `least` times, are no
    known words and whose halves, in either cut, go together with `least_pmi`: the earlier, fixed-weight lexicon's."""
    own = counts.filter(F.rlike("gram", F.lit(f"^[{tx.SCRIPTS[script]}]+$")))
    found = ngrams.pmi(own.select("n", "gram", "c"), least).filter((F.col("n") <= 3) & (F.col("pmi") >= least_pmi))
    return found.select(F.col("gram").alias("text"), "c").join(known.select("text"), "text", "left_anti")
