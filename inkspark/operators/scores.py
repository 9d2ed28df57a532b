"""Scores of decoding and ranking: outputs against gold texts, errors by kind, coverage, causes of misses, order bias."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkspark.functions import phonetics as ph

_chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")


def equal_characters(a: Column | str, b: Column | str) -> Column:
    """How many places of two texts agree; 0 where their lengths differ."""
    both = F.size(F.filter(F.zip_with(_chars(a), _chars(b), lambda x, y: x.eqNullSafe(y)), lambda e: e))
    return F.when(F.length(a) == F.length(b), both).otherwise(0)


def decode_scores(items: DataFrame, outputs: DataFrame, keys: tuple[str, ...] = (), ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """keys, items, sentence_accuracy, character_accuracy, recall_<k>, corrected_top.

    items: keys, item_id, gold; outputs: keys, item_id, rank (from 0), text, corrected. Items without output count.
    """
    at = [*keys, "item_id"]
    joined = items.join(outputs, at, "left")
    per = joined.groupBy(*at, "gold").agg(F.max(F.when(F.col("rank") == 0, F.col("text"))).alias("top"), F.min(F.when(F.col("text") == F.col("gold"), F.col("rank"))).alias("hit"), F.coalesce(F.bool_or(F.when(F.col("rank") == 0, F.col("corrected"))), F.lit(False)).alias("fixed"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    right = F.sum(F.coalesce(equal_characters("top", "gold"), F.lit(0)))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), share(F.col("hit") == 0).alias("sentence_accuracy"), (right / F.nullif(F.sum(F.length("gold")), F.lit(0))).alias("character_accuracy"), *(share(F.col("hit") < k).alias(f"recall_{k}") for k in ks), F.count_if("fixed").alias("corrected_top"))


def clean_safety(items: DataFrame, system: DataFrame, exact: DataFrame) -> DataFrame:
    """items, false_correction_rate, regressions, regression_rate on right inputs; system and exact: item_id, text (the
    first output), corrected."""
    met = items.join(system.select("item_id", F.col("text").alias("s"), "corrected"), "item_id", "left").join(exact.select("item_id", F.col("text").alias("e")), "item_id", "left")
    lost = F.coalesce(F.col("e") == F.col("gold"), F.lit(False)) & ~F.coalesce(F.col("s") == F.col("gold"), F.lit(False))
    return met.agg(F.count(F.lit(1)).alias("items"), F.avg(F.when(F.coalesce("corrected", F.lit(False)), 1.0).otherwise(0.0)).alias("false_correction_rate"), F.count_if(lost).alias("regressions"), F.avg(F.when(lost, 1.0).otherwise(0.0)).alias("regression_rate"))


def character_errors(items: DataFrame, groups: DataFrame, lexicon: DataFrame) -> DataFrame:
    """item_id, position, label of wrong characters: their group where gold and predicted share one, else homophone
    (the predicted character has the reading) or non_homophone; one length_mismatch where lengths differ.

    items: item_id, gold, predicted, readings; groups: ch, group; lexicon: text, reading.
    """
    uneven = items.filter("length(gold) <> length(predicted)").select("item_id", F.lit(-1).alias("position"), F.lit("length_mismatch").alias("label"))
    zipped = F.arrays_zip(_chars("gold").alias("g"), _chars("predicted").alias("p"), F.col("readings").alias("r"))
    each = items.filter("length(gold) = length(predicted)").select("item_id", F.posexplode(zipped).alias("position", "x")).select("item_id", "position", "x.*").filter("g <> p")
    of = lambda c: groups.select(F.col("ch").alias(c), F.col("group").alias(f"{c}_group"))
    pairs = lexicon.select(F.col("text").alias("p"), F.col("reading").alias("r"), F.lit(True).alias("has")).distinct()
    met = each.join(of("g"), "g", "left").join(of("p"), "p", "left").join(pairs, ["p", "r"], "left")
    label = F.when(F.col("g_group") == F.col("p_group"), F.col("g_group")).when(F.col("has"), "homophone_other").otherwise("non_homophone")
    return met.select("item_id", "position", label.alias("label")).unionByName(uneven)


def best_matches(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, top1, character_accuracy (the best of a case's acceptable texts), mrr; results: top, acceptable, rank
    (from 0, null for absent)."""
    best = F.array_max(F.transform("acceptable", lambda a: equal_characters(a, F.col("top")) / F.greatest(F.length(a), F.lit(1))))
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("rank") == 0, 1.0).otherwise(0.0)).alias("top1"), F.avg(F.coalesce(best, F.lit(0.0))).alias("character_accuracy"), F.avg(F.coalesce(1.0 / (F.col("rank") + 1), F.lit(0.0))).alias("mrr"))


def ranking_summary(outcomes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All of a ranker's summary from rows of answer_rank, baseline_rank (from 0), status, fallback_reason, latency_ms,
    model_latency_ms, contextual_top_correct, context_confident, effective_weight, forward_passes, questions,
    disagreement and order_instability; null, not 0, where nothing was measured."""
    top, was = F.col("answer_rank") == 0, F.col("baseline_rank") == 0
    sure, right = F.col("context_confident"), F.col("contextual_top_correct")
    stats = [x for c in ("latency_ms", "model_latency_ms") for x in (F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(0.5)).alias(f"{c}_p50"), F.percentile(c, F.lit(0.95)).alias(f"{c}_p95"))]
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), F.avg(F.when(top, 1.0).otherwise(0.0)).alias("top1"), F.avg(1.0 / (F.col("answer_rank") + 1)).alias("mrr"),
        F.count_if(was & ~top).alias("regressions"), F.count_if(~was & top).alias("improvements"), F.count_if(F.col("answer_rank") == F.col("baseline_rank")).alias("unchanged"),
        F.count_if(F.col("status") == "fallback").alias("fallbacks"), F.count_if(F.col("fallback_reason") == "timeout").alias("timeouts"), *stats,
        F.count("context_confident").alias("assessed"), F.count_if(sure).alias("confident"), F.count_if(sure & ~right).alias("high_confidence_wrong"), F.count_if(~sure & right).alias("low_confidence_correct"),
        F.avg("effective_weight").alias("mean_effective_weight"), F.sum("forward_passes").alias("forward_passes"), F.sum("questions").alias("questions"), F.avg("disagreement").alias("mean_disagreement"), F.avg("order_instability").alias("mean_order_instability"),
    )


def temporal_summary(first: DataFrame, second: DataFrame) -> DataFrame:
    """How cases go from the first to the second moment (case_id, top_text, target_text, target_correct,
    ambiguous_at_t0, answer_rank), over those that both have."""
    a = first.select("case_id", F.col("target_correct").alias("a"), F.col("top_text").alias("at"), F.col("ambiguous_at_t0").alias("aa"))
    met = a.join(second.select("case_id", F.col("target_correct").alias("b"), F.col("target_text").alias("bt"), F.col("ambiguous_at_t0").alias("ba"), "answer_rank"), "case_id")
    x, y = F.col("a"), F.col("b")
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    changed = F.count_if(F.col("at") != F.col("bt"))
    return met.agg(
        F.count(F.lit(1)).alias("paired"), one(x).alias("initial_top1"), one(y).alias("final_top1"), one(F.col("answer_rank") == 0).alias("final_sequence_top1"), F.count_if(~x & y).alias("wrong_to_correct"), F.count_if(x & ~y).alias("correct_to_wrong"),
        F.count_if(x & y).alias("unchanged_correct"), F.count_if(~x & ~y).alias("unchanged_wrong"), changed.alias("changed"), (F.count_if(~x & y) / F.nullif(changed, F.lit(0))).alias("correction_precision"),
        F.count_if(~x & y & F.col("ba")).alias("wrong_to_correct_ambiguous"), F.count_if(~x & F.col("aa")).alias("initial_wrong_ambiguous"),
    )


def coverage_summary(results: DataFrame, keys: tuple[str, ...] = (), ks: tuple[int, ...] = (1, 3, 5, 10), top: int = 5) -> DataFrame:
    """Recalls and losses of results: rank, final_rank (from 0, null for absent), reachable, window_hit, candidates,
    families, latency_ms."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    rank, final, can = F.col("rank"), F.col("final_rank"), F.col("reachable")
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"), *(share(rank < k).alias(f"recall_{k}") for k in ks), share(final.isNotNull()).alias("recall_unlimited"), share(can).alias("reachable"), share(F.col("window_hit")).alias("window_recall"),
        F.count_if(final.isNotNull() & (rank.isNull() | (rank >= top))).alias("outside_top"), F.count_if(final.isNull()).alias("never_generated"), F.count_if(~can).alias("unreachable"), F.count_if(can & final.isNull()).alias("beam_pruned"),
        F.avg("candidates").alias("mean_candidates"), F.avg("families").alias("mean_families"), F.percentile("latency_ms", F.lit(0.5)).alias("latency_p50"), F.percentile("latency_ms", F.lit(0.95)).alias("latency_p95"),
    )


def lexical_coverage(cases: DataFrame, lexicon: DataFrame) -> DataFrame:
    """oov_rate, reading_coverage, word_coverage of cases (text, readings, words: array of start, end, text) over a
    lexicon (text, reading): characters without their reading, readings with any entry, words of two and more found."""
    each = cases.select(F.explode(F.arrays_zip(_chars("text").alias("char"), F.col("readings").alias("reading"))).alias("x")).select("x.*").groupBy("char", "reading").agg(F.count(F.lit(1)).alias("m"))
    own = lexicon.select(F.col("text").alias("char"), "reading", F.lit(True).alias("own")).distinct()
    some = lexicon.select("reading", F.lit(True).alias("some")).distinct()
    chars = each.join(own, ["char", "reading"], "left").join(some, "reading", "left").agg((1 - F.sum(F.when(F.col("own"), F.col("m")).otherwise(0)) / F.nullif(F.sum("m"), F.lit(0))).alias("oov_rate"), (F.sum(F.when(F.col("some"), F.col("m")).otherwise(0)) / F.nullif(F.sum("m"), F.lit(0))).alias("reading_coverage"))
    words = cases.select("readings", F.explode("words").alias("w")).filter("w.end - w.start >= 2").select(F.col("w.text").alias("char"), F.expr("array_join(slice(readings, w.start + 1, w.end - w.start), ' ')").alias("reading"))
    return chars.crossJoin(words.join(own, ["char", "reading"], "left").agg(F.avg(F.when(F.col("own"), 1.0).otherwise(0.0)).alias("word_coverage")))


def recall_at(cases: DataFrame, candidates: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """n and recall_<k> of cases (case_id, target) among candidates (case_id, rank from 0, text)."""
    hit = cases.join(candidates, "case_id", "left").groupBy("case_id", "target").agg(F.min(F.when(F.col("text") == F.col("target"), F.col("rank"))).alias("hit"))
    return hit.agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.when(F.col("hit") < k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks))


def causes(results: DataFrame, lexicon: DataFrame) -> DataFrame:
    """item_id, stage, category, position of missed cases: the first cause that applies.

    results: item_id, gold, top1, readings, words (start, end, text, proper_noun, colloquial), stage, rank, window_hit,
    exact_surface; lexicon: text, reading.
    """
    differs = F.array_position(F.zip_with(_chars("gold"), _chars("top1"), lambda a, b: a.eqNullSafe(b) | a.isNull() | b.isNull()), False) - 1
    rows = results.withColumn("diff", F.when(F.coalesce("top1", F.lit("")) == "", 0).when(differs >= 0, differs))
    own = lexicon.select("text", "reading").distinct()
    # Unreachable: the first character that the lexicon has not under its reading.
    at = rows.filter("stage = 'unreachable'").select("item_id", F.posexplode(F.arrays_zip(_chars("gold").alias("text"), F.col("readings").alias("reading"))).alias("i", "x")).select("item_id", "i", "x.*")
    lacking = at.join(own, ["text", "reading"], "left_anti").groupBy("item_id").agg(F.min(F.struct("i", "text", "reading")).alias("l")).select("item_id", "l.*")
    free = lacking.select("item_id", "text", F.explode(ph.tone_variants("reading")).alias("reading")).join(own, ["text", "reading"], "left_semi").select("item_id", F.lit(True).alias("variant")).distinct()
    lack = lacking.join(free, "item_id", "left").select("item_id", "i", F.coalesce("variant", F.lit(False)).alias("variant"))
    word = F.get(F.filter("words", lambda w: (w["start"] <= F.col("diff")) & (F.col("diff") < w["end"])), 0)
    worded = rows.withColumn("word", word).withColumn("word_reading", F.when(F.col("word").isNotNull(), F.expr("array_join(slice(readings, word.start + 1, word.end - word.start), ' ')")))
    worded = worded.withColumn("wt", F.col("word.text")).join(own.select(F.col("text").alias("wt"), F.col("reading").alias("word_reading"), F.lit(True).alias("known")), ["wt", "word_reading"], "left")
    met = worded.join(lack, "item_id", "left")
    long = F.length("wt") >= 2
    category = (
        F.when((F.col("stage") == "top5") & ~F.col("window_hit"), "candidate_family_issue")
        .when((F.col("stage") == "unreachable") & F.col("i").isNull(), "other")
        .when((F.col("stage") == "unreachable") & F.col("variant"), "pronunciation_variant_missing")
        .when(F.col("stage") == "unreachable", "character_reading_missing")
        .when(~F.col("exact_surface") & F.col("rank").isNotNull(), "orthographic_variant")
        .when(F.col("word.proper_noun"), "proper_noun").when(F.col("word.colloquial"), "colloquial_word")
        .when(long & F.col("known").isNull(), "lexical_missing").when(long, "segmentation_missing")
        .when(F.col("stage") == "beam_pruned", "beam_pruned").otherwise("score_pruned")
    )
    return met.select("item_id", "stage", category.alias("category"), F.when(F.col("stage") == "unreachable", F.col("i")).otherwise(F.col("diff")).alias("position"))


def taxonomy(missed: DataFrame, examples: int = 4) -> tuple[DataFrame, DataFrame]:
    """(category, stage, n with subtotals as nulls) and up to `examples` items of each category by id."""
    counts = missed.cube("category", "stage").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("category").orderBy("item_id")
    return counts, missed.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= examples).drop("k")


def orders(cases: DataFrame, window: int = 4) -> DataFrame:
    """case_id, order_id, place, option, text: every order of the first `window` candidates (array) of cases with two
    and more; option is the candidate's own place."""
    tables = {k: list(permutations(range(k))) for k in range(2, window + 1)}
    size = F.least(F.size("candidates"), F.lit(window))
    each = F.coalesce(*(F.when(size == k, F.array(*(F.array(*map(F.lit, p)) for p in table))) for k, table in tables.items()))
    some = cases.filter(F.size("candidates") > 1).select("case_id", "candidates", F.posexplode(each).alias("order_id", "o")).select("case_id", "candidates", "order_id", F.posexplode("o").alias("place", "option"))
    return some.select("case_id", "order_id", "place", "option", F.get("candidates", F.col("option")).alias("text"))


def order_bias(decisions: DataFrame) -> DataFrame:
    """cases, orders_per_case, flip_rate, first_position_wins, chance, spread, agreement of decisions (case_id,
    order_id, place, option, p) over all orders; order 0 is the original one, and ties go to the lesser option."""
    per_order = decisions.groupBy("case_id", "order_id").agg(F.min_by(F.struct("option", "place"), F.struct(-F.col("p"), "option")).alias("w"), F.count(F.lit(1)).alias("k")).select("case_id", "order_id", F.col("w.option").alias("winner"), F.col("w.place").alias("place"), "k")
    per_option = decisions.groupBy("case_id", "option").agg((F.max("p") - F.min("p")).alias("spread"), F.avg("p").alias("mean"))
    best = per_option.groupBy("case_id").agg(F.min_by("option", F.struct(-F.col("mean"), "option")).alias("best"), F.sum("spread").alias("spread"), F.count(F.lit(1)).alias("m"))
    cases = per_order.groupBy("case_id").agg(F.count_distinct("winner").alias("winners"), F.max(F.when(F.col("order_id") == 0, F.col("winner"))).alias("original"), F.count_if(F.col("place") == 0).alias("first"), F.count(F.lit(1)).alias("orders"), F.first("k").alias("k"))
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return cases.join(best, "case_id").agg(F.count(F.lit(1)).alias("cases"), F.max("orders").alias("orders_per_case"), one(F.col("winners") > 1).alias("flip_rate"), (F.sum("first") / F.sum("orders")).alias("first_position_wins"), F.avg(1.0 / F.col("k")).alias("chance"), (F.sum("spread") / F.sum("m")).alias("spread"), one(F.col("best") == F.col("original")).alias("agreement"))


def families(candidates: DataFrame, rules: dict[str, str]) -> DataFrame:
    """case_id, family, representative, members, rank of candidates (case_id, rank, text) whose texts are one but for
    variant characters; a family's place is that of its best member."""
    from inkspark.functions import text as tx

    grouped = candidates.groupBy("case_id", tx.family_key("text", rules).alias("family")).agg(F.min_by("text", "rank").alias("representative"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("members"), F.min("rank").alias("best"))
    return grouped.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("best")) - 1).drop("best")


def gated(scores: DataFrame, reference: dict[str, float], drops: dict[str, float], primary: str, ties: tuple[Column, ...], eligible: str = "production_eligible", items: int = 300) -> DataFrame:
    """`scores` with failures (of eligibility, and of each metric that falls short of the reference by more than its
    allowed drop), tied (within one item of the best that fails nothing) and selected (the first of those by `ties`)."""
    failures = F.array_compact(F.array(F.when(~F.col(eligible), F.lit("not_production_eligible")), *(F.when(F.round(F.lit(reference[m]) - F.col(m), 6) > most, F.lit(f"{m}_regression")) for m, most in drops.items())))
    judged = scores.withColumn("failures", failures)
    fit = F.size("failures") == 0
    best = judged.agg(F.max(F.when(fit, F.col(primary))).alias("__best"))
    near = judged.crossJoin(F.broadcast(best)).withColumn("tied", F.coalesce(fit & (F.col("__best") - F.col(primary) <= 1 / items + 1e-9), F.lit(False))).drop("__best")
    # A plan has a handful of configurations.
    first = near.filter("tied").agg(F.min(F.struct(*(t.alias(f"t{i}") for i, t in enumerate(ties)))).alias("__first"))
    return near.crossJoin(F.broadcast(first)).withColumn("selected", F.col("tied") & F.struct(*(t.alias(f"t{i}") for i, t in enumerate(ties))).eqNullSafe(F.col("__first"))).drop("__first")


def capacity(runs: DataFrame, slack: dict[str, float]) -> DataFrame:
    """`runs` (name, capacity, signature and timings) with acceptable (each timing within its share of the best bounded
    one) and selected: the least acceptable capacity, none where signatures differ or the capacity is unbounded."""
    bounded = F.col("capacity") > 0
    best = runs.agg(F.count_distinct("signature").alias("__s"), *(F.min(F.when(bounded, F.col(c))).alias(f"__{c}") for c in slack))
    fit = bounded
    for c, share in slack.items():
        fit = fit & (F.col(c) <= F.col(f"__{c}") * share)
    near = runs.crossJoin(F.broadcast(best)).withColumn("acceptable", F.coalesce(fit, F.lit(False)))
    least = near.filter("acceptable and __s = 1").agg(F.min("capacity").alias("__least"))
    return near.crossJoin(F.broadcast(least)).withColumn("selected", F.coalesce(F.col("acceptable") & (F.col("capacity") == F.col("__least")), F.lit(False))).select(*runs.columns, "acceptable", "selected")


def same_outputs(a: DataFrame, b: DataFrame, digits: int | None = 9) -> DataFrame:
    """case_id of cases whose candidates (case_id, rank, text, score) differ between two runs, scores to `digits`."""
    shaped = lambda df: df.select("case_id", "rank", "text", F.col("score") if digits is None else F.round("score", digits).alias("score"))
    x, y = shaped(a), shaped(b)
    return x.exceptAll(y).select("case_id").union(y.exceptAll(x).select("case_id")).distinct()


def signatures(candidates: DataFrame, digits: int = 9) -> DataFrame:
    """case_id, signature: SHA-256 of a case's ordered texts and scores."""
    line = F.concat_ws("\t", "text", F.format_number("score", digits))
    return candidates.groupBy("case_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("signature"))


def stale(cases: DataFrame, decoded: DataFrame) -> DataFrame:
    """case_id of cases (case_id, candidates) whose candidates are not what decoding (case_id, rank, text) gives now."""
    now = decoded.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("now"))
    return cases.join(now, "case_id", "left").filter(~F.col("candidates").eqNullSafe(F.coalesce("now", F.array().cast("array<string>")))).select("case_id")


def cache_memory(runs: DataFrame, bytes_per_entry: float) -> DataFrame:
    """`runs` (name, entries) with megabytes."""
    return runs.withColumn("megabytes", F.round(F.col("entries") * bytes_per_entry / 1e6, 3))
