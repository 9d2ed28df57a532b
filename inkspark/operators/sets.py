"""Evaluation sets: annotated clauses of a corpus, hand-written items, ranking cases from scenarios, their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkspark.functions import text as tx
from inkspark.operators import cases as case_ops


def clauses(sentences: DataFrame, shortest: int, longest: int, script: str = "han_bmp") -> DataFrame:
    """`sentences` (source_id, doc_id, text and more) by clause: runs of the script of the given lengths, with the text
    before them and key, the SHA-256 that orders them."""
    run = F.regexp_extract_all("text", F.lit(f"[{tx.SCRIPTS[script]}]+"), F.lit(0))
    gaps = F.split("text", f"[{tx.SCRIPTS[script]}]+", -1)
    # What stands before a run is cut from the text by its length: where it is not asked for, the text is not carried.
    size = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    left = F.left("text", size(gaps, F.col("__i") + 1) + size(run, F.col("__i")))
    each = sentences.select("*", F.posexplode(run).alias("__i", "clause"))
    key = F.sha2(F.concat("source_id", F.lit("\0"), F.col("doc_id").cast("string"), F.lit("\0"), "clause"), 256)
    return each.filter(F.length("clause").between(shortest, longest)).select(*sentences.columns, left.alias("left_context"), "clause", key.alias("key"))


def silver(sentences: DataFrame, annotations: DataFrame, by: str, most: int, shortest: int = 4, longest: int = 10, script: str = "han_bmp") -> DataFrame:
    """The first `most` annotated clauses of each `by` by key: item_id, origin, left_context, readings, gold.

    annotations: text, readings (null: refused)."""
    fit = clauses(sentences, shortest, longest, script).join(annotations.filter("readings is not null").select(F.col("text").alias("clause"), "readings"), "clause")
    w = Window.partitionBy(by).orderBy("key", "left_context")
    picked = fit.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    return picked.select(F.concat_ws(":", "source_id", F.left("key", F.lit(12))).alias("item_id"), F.concat(F.lit("silver:"), by).alias("origin"), "left_context", "readings", F.col("clause").alias("gold"))


def refusals(sentences: DataFrame, annotations: DataFrame, by: str, shortest: int = 4, longest: int = 10, script: str = "han_bmp") -> DataFrame:
    """by, outcome, n: how many clauses were accepted, or refused for which reason."""
    met = clauses(sentences, shortest, longest, script).join(annotations.select(F.col("text").alias("clause"), "reason"), "clause", "left")
    return met.groupBy(by, F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def formal_set(sentences: DataFrame, annotations: DataFrame, near: DataFrame, by: str, most: int = 200, per_document: int = 3, shortest: int = 4, longest: int = 12, script: str = "han_bmp") -> DataFrame:
    """item_id, category, left_context, text, readings, source_id, doc_id: by key, at most `per_document` clauses of a
    document and then `most` of each `by`; sentences whose text is in `near` (text) give none."""
    clean = sentences.join(near.select("text").distinct(), "text", "left_anti")
    fit = clauses(clean, shortest, longest, script).join(annotations.filter("readings is not null").select(F.col("text").alias("clause"), "readings"), "clause")
    each = fit.withColumn("d", F.row_number().over(Window.partitionBy(by, "source_id", "doc_id").orderBy("key", "left_context"))).filter(F.col("d") <= per_document)
    picked = each.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("key", "left_context"))).filter(F.col("r") <= most)
    return picked.select(F.concat_ws(":", F.lit("gov"), "source_id", F.left("key", F.lit(12))).alias("item_id"), F.col(by).alias("category"), "left_context", F.col("clause").alias("text"), "readings", "source_id", "doc_id")


def everyday_items(lines: DataFrame, replacements: tuple[tuple[str, str], ...]) -> DataFrame:
    """item_id, category, left_context, text, readings, acceptable of TSV lines (value): id, category, context, text,
    readings and, if any, alternatives between bars; an id that stands twice is an error."""
    cut = lines.filter("trim(value) <> '' and not startswith(value, '#')").select(F.split("value", "\t").alias("p"))
    rows = cut.select(F.concat(F.lit("everyday:"), F.get("p", 0)).alias("item_id"), F.get("p", 1).alias("category"), F.get("p", 2).alias("left_context"), F.get("p", 3).alias("text"), F.filter(F.split(F.get("p", 4), " +"), lambda r: r != "").alias("readings"), F.split(F.coalesce(F.get("p", 5), F.lit("")), r"\|").alias("manual"))
    return once(rows.withColumn("acceptable", case_ops.alternates("text", replacements, "manual")).drop("manual"), "item_id")


def coverage_items(lines: DataFrame) -> DataFrame:
    """item_id, category, left_context, text, words (text, proper_noun, colloquial, start, end), readings, acceptable of
    TSV lines (value) with segmented texts, whose words end in # (proper noun) or ~ (colloquial)."""
    cut = lines.filter("trim(value) <> '' and not startswith(value, '#')").select("value", F.split("value", "\t").alias("p"))
    short = F.when(F.size("p") < 5, F.raise_error(F.concat(F.lit("fields are missing: "), "value"))).otherwise(F.get("p", 0))
    rows = cut.select(F.concat(F.lit("coverage:"), short).alias("item_id"), F.get("p", 1).alias("category"), F.get("p", 2).alias("left_context"), F.filter(F.split(F.get("p", 3), " +"), lambda t: t != "").alias("tokens"), F.filter(F.split(F.get("p", 4), " +"), lambda r: r != "").alias("readings"), F.filter(F.split(F.coalesce(F.get("p", 5), F.lit("")), r"\|"), lambda a: a != "").alias("manual"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,proper_noun:boolean,colloquial:boolean,start:int,end:int>>").alias("out"))
    bare = lambda t: F.regexp_replace(t, "[#~]+$", "")
    step = lambda s, t: F.struct((s["at"] + F.length(bare(t))).alias("at"), F.concat(s["out"], F.array(F.struct(bare(t).alias("text"), t.endswith("#").alias("proper_noun"), t.endswith("~").alias("colloquial"), s["at"].alias("start"), (s["at"] + F.length(bare(t))).alias("end")))).alias("out"))
    out = rows.withColumn("words", F.aggregate("tokens", start, step, lambda s: s["out"])).withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), ""))
    return once(out.select("item_id", "category", "left_context", "text", "words", "readings", F.array_distinct(F.concat(F.array("text"), "manual")).alias("acceptable")), "item_id")


def once(rows: DataFrame, key: str) -> DataFrame:
    """`rows`, an error where a key stands twice."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return rows.join(n, key).withColumn(key, F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("stands twice: "), F.col(key).cast("string")))).otherwise(F.col(key))).select(*rows.columns)


def scenario_issues(scenarios: DataFrame) -> DataFrame:
    """case_id, issue of scenarios: unequal lengths of texts and readings, a target that is no acceptable answer, final
    answers without target and suffix."""
    found = F.array_compact(F.array(
        F.when(F.length("target") != F.size("target_readings"), F.lit("target_readings")), F.when(F.length("suffix") != F.size("suffix_readings"), F.lit("suffix_readings")),
        F.when(~F.array_contains("acceptable_at_t0", F.col("target")), F.lit("target_not_acceptable")),
        F.when((F.size("final_answers") > 0) & ~F.array_contains("final_answers", F.concat("target", "suffix")), F.lit("final_answers")),
    ))
    return scenarios.select("case_id", F.explode(found).alias("issue"))


def case_issues(cases: DataFrame) -> DataFrame:
    """case_id, issue of ranking cases: no or repeated candidates, scores that are missing or not finite, answers that
    are no candidates."""
    bad = F.exists("baseline_scores", lambda s: s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")))
    found = F.array_compact(F.array(
        F.when(F.size("candidates") == 0, F.lit("no_candidates")), F.when(F.size(F.array_distinct("candidates")) != F.size("candidates"), F.lit("repeated_candidates")),
        F.when((F.size("candidates") != F.size("baseline_scores")) | bad, F.lit("scores")), F.when((F.size("answers") == 0) | (F.size(F.array_except("answers", "candidates")) > 0), F.lit("answers")),
    ))
    return cases.select("case_id", F.explode(found).alias("issue"))


def hand_items(scenarios: DataFrame, origin: str) -> DataFrame:
    """item_id, origin, left_context, readings, gold: scenarios read to their ends."""
    return scenarios.select(F.concat(F.lit(f"{origin}:"), "case_id").alias("item_id"), F.lit(f"hand:{origin}").alias("origin"), F.col("context").alias("left_context"), F.concat("target_readings", "suffix_readings").alias("readings"), F.concat("target", "suffix").alias("gold"))


def ranking_cases(scenarios: DataFrame, candidates: DataFrame, composed: bool) -> DataFrame:
    """case_id, left_context, readings, candidates, baseline_scores, answers, target, target_length, ambiguous_at_t0,
    tags, target_variants, excluded of each scenario; excluded: its text is no candidate, so it is no case.

    candidates: case_id, rank, text, score of the target's readings, or with `composed` those to the suffix's end.
    """
    lists = candidates.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "score"))).alias("c")).select("case_id", F.transform("c", lambda x: x["text"]).alias("candidates"), F.transform("c", lambda x: x["score"]).alias("baseline_scores"))
    met = scenarios.join(lists, "case_id", "left").withColumns({c: F.coalesce(c, F.array().cast(f"array<{t}>")) for c, t in (("candidates", "string"), ("baseline_scores", "double"))})
    whole = F.concat("target", "suffix") if composed else F.col("target")
    wanted = F.when(F.size("final_answers") > 0, F.col("final_answers")).otherwise(F.array(whole)) if composed else F.col("acceptable_at_t0")
    ambiguous = F.size("acceptable_at_t0") > 1
    tag = F.array(F.when(F.col("suffix") != "", "with_suffix").otherwise("no_suffix")) if composed else F.when(ambiguous, F.array(F.lit("ambiguous"))).otherwise(F.array().cast("array<string>"))
    variants = F.sort_array(F.array_except(F.array_distinct(F.transform("final_answers", lambda a: F.left(a, F.length("target")))), F.array("target")))
    return met.select("case_id", F.col("context").alias("left_context"), (F.concat("target_readings", "suffix_readings") if composed else F.col("target_readings")).alias("readings"), "candidates", "baseline_scores", F.filter(wanted, lambda a: F.array_contains("candidates", a)).alias("answers"), "target", F.length("target").alias("target_length"), ambiguous.alias("ambiguous_at_t0"), F.concat("tags", tag).alias("tags"), variants.alias("target_variants"), (~F.array_contains("candidates", whole)).alias("excluded"))


def case_outcomes(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """case_id, answer_rank, baseline_rank (from 0), top_text, target_text, target_correct, ambiguous_at_t0, permuted: a
    ranker's outcome for each case; permuted: its texts (case_id, rank, text) are the candidates in some order."""
    texts = ranked.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
    first = lambda c: F.coalesce(F.array_min(F.filter(F.transform("answers", lambda a: F.array_position(c, a).cast("int") - 1), lambda i: i >= 0)), F.lit(None).cast("int"))
    target = F.left(F.get("texts", 0), F.col("target_length"))
    return cases.join(texts, "case_id").select("case_id", first("texts").alias("answer_rank"), first("candidates").alias("baseline_rank"), F.get("texts", 0).alias("top_text"), target.alias("target_text"), ((target == F.col("target")) | F.array_contains("target_variants", target)).alias("target_correct"), "ambiguous_at_t0", (F.sort_array("texts") == F.sort_array("candidates")).alias("permuted"))


def set_issues(items: DataFrame, readings: DataFrame) -> DataFrame:
    """item_id, issue of a test set: repeated ids, noisy readings equal to the clean ones, and `readings` issues."""
    twice = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("item_id", F.lit("repeated_id").alias("issue"))
    same = items.filter("noisy_readings is not null and noisy_readings = readings").select("item_id", F.lit("noise_without_effect").alias("issue"))
    return twice.unionByName(same).unionByName(readings.select("item_id", "issue"))
