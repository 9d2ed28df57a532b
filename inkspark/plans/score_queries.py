"""Queries of scores, rankings, selections and evaluation sets, on outcomes made from the driver's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.operators import annotation, metrics, ranking, scores, sets
from inkspark.plans.derived_queries import RATED, VOWELS, char_readings, han, known_words, rated_words, sql_han
from inkspark.plans.registry import query, table
from inkspark.sources.shared import written

#: Outcomes of events, read by both engines.
_OUTCOME = {
    "answer_rank": "event_id % 5", "baseline_rank": "event_id % 4", "status": "CASE WHEN event_id % 11 = 0 THEN 'fallback' ELSE 'ok' END", "fallback_reason": "CASE WHEN event_id % 22 = 0 THEN 'timeout' WHEN event_id % 11 = 0 THEN 'backend_error' END",
    "latency_ms": "value", "model_latency_ms": "CASE WHEN event_id % 3 > 0 THEN value / 2 END", "contextual_top_correct": "CASE WHEN event_id % 11 > 0 THEN event_id % 2 = 0 END", "context_confident": "CASE WHEN event_id % 11 > 0 THEN event_id % 3 = 0 END",
    "effective_weight": "CASE WHEN event_id % 11 > 0 THEN (event_id % 7) / CAST(10 AS DOUBLE) END", "forward_passes": "event_id % 13", "questions": "event_id % 6", "disagreement": "CASE WHEN event_id % 5 = 0 THEN (event_id % 9) / CAST(9 AS DOUBLE) END", "order_instability": "CAST(NULL AS DOUBLE)",
}
_OUTCOMES = f"o AS (SELECT event_type, {', '.join(f'{e} AS {c}' for c, e in _OUTCOME.items())} FROM events)"
_ONE = lambda c: f"round(avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END), 6)"


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" and c not in keep else c for c, t in df.dtypes))


@query(f"""WITH {_OUTCOMES} SELECT event_type, count(*) AS cases, {_ONE('answer_rank = 0')} AS top1, round(avg(1.0::DOUBLE / (answer_rank + 1)), 6) AS mrr, count(*) FILTER (baseline_rank = 0 AND answer_rank > 0) AS regressions, count(*) FILTER (baseline_rank > 0 AND answer_rank = 0) AS improvements,
count(*) FILTER (answer_rank = baseline_rank) AS unchanged, count(*) FILTER (status = 'fallback') AS fallbacks, count(*) FILTER (fallback_reason = 'timeout') AS timeouts, count(latency_ms) AS latency_ms_n, round(avg(latency_ms), 6) AS latency_ms_mean, round(quantile_cont(latency_ms, 0.5), 6) AS latency_ms_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_ms_p95,
count(model_latency_ms) AS model_latency_ms_n, round(avg(model_latency_ms), 6) AS model_latency_ms_mean, round(quantile_cont(model_latency_ms, 0.5), 6) AS model_latency_ms_p50, round(quantile_cont(model_latency_ms, 0.95), 6) AS model_latency_ms_p95, count(context_confident) AS assessed, count(*) FILTER (context_confident) AS confident,
count(*) FILTER (context_confident AND NOT contextual_top_correct) AS high_confidence_wrong, count(*) FILTER (NOT context_confident AND contextual_top_correct) AS low_confidence_correct, round(avg(effective_weight), 6) AS mean_effective_weight, sum(forward_passes)::BIGINT AS forward_passes, sum(questions)::BIGINT AS questions, round(avg(disagreement), 6) AS mean_disagreement, avg(order_instability) AS mean_order_instability FROM o GROUP BY 1""")
def ranking_summary_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", *(F.expr(e).alias(c) for c, e in _OUTCOME.items()))
    return _rounded(scores.ranking_summary(rows, ("event_type",)))


_FIRST = {"case_id": "event_id", "target_correct": "value > 50", "top_text": "event_type", "ambiguous_at_t0": "event_id % 3 = 0"}
_SECOND = {"case_id": "event_id", "target_correct": "event_id % 7 < 4", "target_text": "CASE WHEN event_id % 5 = 0 THEN 'click' ELSE event_type END", "ambiguous_at_t0": "event_id % 3 = 0", "answer_rank": "event_id % 4"}


@query(f"""WITH a AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _FIRST.items())} FROM events WHERE value IS NOT NULL), b AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _SECOND.items())} FROM events),
m AS (SELECT a.target_correct AS x, b.target_correct AS y, top_text <> target_text AS changed, a.ambiguous_at_t0 AS u, answer_rank FROM a JOIN b USING (case_id))
SELECT count(*) AS paired, {_ONE('x')} AS initial_top1, {_ONE('y')} AS final_top1, {_ONE('answer_rank = 0')} AS final_sequence_top1, count(*) FILTER (NOT x AND y) AS wrong_to_correct, count(*) FILTER (x AND NOT y) AS correct_to_wrong, count(*) FILTER (x AND y) AS unchanged_correct, count(*) FILTER (NOT x AND NOT y) AS unchanged_wrong,
count(*) FILTER (changed) AS changed, round(count(*) FILTER (NOT x AND y) / count(*) FILTER (changed), 6) AS correction_precision, count(*) FILTER (NOT x AND y AND u) AS wrong_to_correct_ambiguous, count(*) FILTER (NOT x AND u) AS initial_wrong_ambiguous FROM m""")
def temporal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    first = rows.filter("value is not null").select(*(F.expr(e).alias(c) for c, e in _FIRST.items()))
    second = rows.select(*(F.expr(e).alias(c) for c, e in _SECOND.items()))
    return _rounded(scores.temporal_summary(first, second))


_RESULT = {"rank": "CASE WHEN event_id % 3 > 0 THEN event_id % 12 END", "final_rank": "CASE WHEN event_id % 5 > 0 THEN event_id % 30 END", "reachable": "event_id % 7 > 0", "window_hit": "event_id % 4 = 0", "candidates": "event_id % 20", "families": "event_id % 9", "latency_ms": "value"}


@query(f"""WITH o AS (SELECT event_type, {', '.join(f'{e} AS {c}' for c, e in _RESULT.items())} FROM events) SELECT event_type, count(*) AS items, {', '.join(f"{_ONE(f'rank < {k}')} AS recall_{k}" for k in (1, 3, 5, 10))}, {_ONE('final_rank IS NOT NULL')} AS recall_unlimited, {_ONE('reachable')} AS reachable, {_ONE('window_hit')} AS window_recall,
count(*) FILTER (final_rank IS NOT NULL AND (rank IS NULL OR rank >= 5)) AS outside_top, count(*) FILTER (final_rank IS NULL) AS never_generated, count(*) FILTER (NOT reachable) AS unreachable, count(*) FILTER (reachable AND final_rank IS NULL) AS beam_pruned, round(avg(candidates), 6) AS mean_candidates, round(avg(families), 6) AS mean_families,
round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95 FROM o GROUP BY 1""")
def coverage_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", *(F.expr(e).alias(c) for c, e in _RESULT.items()))
    return _rounded(scores.coverage_summary(rows, ("event_type",)))


_OUTPUTS = """outputs AS (SELECT a.n_nationkey AS item_id, a.n_name AS gold, a.n_regionkey AS region, b.n_name AS text, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY abs(len(a.n_name) - len(b.n_name)), b.n_name) - 1 AS rank, b.n_nationkey % 4 = 0 AS corrected FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND (a.n_nationkey + b.n_nationkey) % 3 > 0)"""


def _outputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.window import Window

    nation = table(spark, sf_dir, "nation")
    items = nation.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("item_id"), F.col("n_name").alias("gold"))
    other = nation.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("text"))
    met = items.join(other, "region").filter("(item_id + k) % 3 > 0")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.abs(F.length("gold") - F.length("text")), "text")) - 1
    return items, met.withColumn("rank", rank).select("region", "item_id", "rank", "text", (F.col("k") % 4 == 0).alias("corrected"))


_EQUAL = "CASE WHEN len(gold) = len(top) THEN len(list_filter(range(1, len(gold) + 1), lambda i: gold[i : i] = top[i : i])) ELSE 0 END"


@query(f"""WITH {_OUTPUTS}, per AS (SELECT n_regionkey AS region, n_nationkey AS item_id, n_name AS gold, max(text) FILTER (rank = 0) AS top, min(rank) FILTER (text = n_name) AS hit, coalesce(bool_or(corrected) FILTER (rank = 0), false) AS fixed FROM nation LEFT JOIN outputs ON item_id = n_nationkey GROUP BY 1, 2, 3)
SELECT region, count(*) AS items, {_ONE('hit = 0')} AS sentence_accuracy, round(sum(coalesce({_EQUAL}, 0)) / sum(len(gold)), 6) AS character_accuracy, {_ONE('hit < 1')} AS recall_1, {_ONE('hit < 5')} AS recall_5, {_ONE('hit < 10')} AS recall_10, count(*) FILTER (fixed) AS corrected_top FROM per GROUP BY 1""")
def decode_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' names as gold, with names of their region as output."""
    items, outputs = _outputs(spark, sf_dir)
    return _rounded(scores.decode_scores(items, outputs, ("region",)))


@query(f"""WITH {_OUTPUTS}, x AS (SELECT n_nationkey AS item_id, n_name AS gold, s.text AS s, coalesce(s.corrected, false) AS corrected, e.text AS e FROM nation LEFT JOIN (SELECT * FROM outputs WHERE rank = 0) s ON s.item_id = n_nationkey LEFT JOIN (SELECT * FROM outputs WHERE rank = 1) e ON e.item_id = n_nationkey)
SELECT count(*) AS items, {_ONE('corrected')} AS false_correction_rate, count(*) FILTER (coalesce(e = gold, false) AND NOT coalesce(s = gold, false)) AS regressions, {_ONE('coalesce(e = gold, false) AND NOT coalesce(s = gold, false)')} AS regression_rate FROM x""")
def clean_input_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, outputs = _outputs(spark, sf_dir)
    return _rounded(scores.clean_safety(items, outputs.filter("rank = 0"), outputs.filter("rank = 1")))


_TEL = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999")


@query(f"""WITH {_OUTPUTS}, x AS (SELECT item_id, gold, text AS predicted FROM outputs WHERE rank <= 2),
c AS (SELECT item_id, predicted, i - 1 AS position, gold[i : i] AS g, predicted[i : i] AS p FROM (SELECT *, unnest(range(1, len(gold) + 1)) AS i FROM x WHERE len(gold) = len(predicted)))
SELECT item_id, predicted, position::INT AS position, CASE WHEN contains('AEIOU', g) AND contains('AEIOU', p) THEN 'vowel' WHEN translate(g, '{_TEL[0]}', '{_TEL[1]}') = translate(p, '{_TEL[0]}', '{_TEL[1]}') THEN 'homophone_other' ELSE 'non_homophone' END AS label FROM c WHERE g <> p
UNION ALL SELECT item_id, predicted, -1, 'length_mismatch' FROM x WHERE len(gold) <> len(predicted)""")
def character_error_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong letters of the first three outputs: vowels are a group, a letter's reading is its telephone key."""
    items, outputs = _outputs(spark, sf_dir)
    key = lambda t: F.filter(F.split(F.translate(t, *_TEL), ""), lambda c: c != "")
    rows = items.join(outputs.filter("rank <= 2"), ["region", "item_id"]).select(F.struct("item_id", F.col("text").alias("predicted")).alias("item_id"), "gold", F.col("text").alias("predicted"), key("gold").alias("readings"))
    groups = spark.createDataFrame([(c, "vowel") for c in "AEIOU"], "ch string, group string")
    lexicon = spark.createDataFrame(list(zip(*_TEL, strict=True)), "text string, reading string")
    return scores.character_errors(rows, groups, lexicon).select("item_id.item_id", "item_id.predicted", "position", "label")


@query(f"""WITH {_OUTPUTS}, t AS (SELECT item_id, max(text) FILTER (rank = 0) AS top, min(rank) FILTER (text = gold) AS rank, any_value(gold) AS g FROM outputs GROUP BY 1), a AS (SELECT *, unnest([g, upper(reverse(g))]) AS gold FROM t),
b AS (SELECT item_id, any_value(rank) AS rank, max({_EQUAL} / greatest(len(gold), 1)) AS best FROM a GROUP BY 1)
SELECT count(*) AS n, {_ONE('rank = 0')} AS top1, round(avg(best), 6) AS character_accuracy, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1.0::DOUBLE / (rank + 1) END), 6) AS mrr FROM b""")
def acceptable_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and their reverses as acceptable texts."""
    items, outputs = _outputs(spark, sf_dir)
    met = outputs.join(items, ["region", "item_id"]).groupBy("item_id", "gold").agg(F.max(F.when(F.col("rank") == 0, F.col("text"))).alias("top"), F.min(F.when(F.col("text") == F.col("gold"), F.col("rank"))).alias("rank"))
    return _rounded(scores.best_matches(met.withColumn("acceptable", F.array("gold", F.reverse("gold")))))


_CHANCE = "((case_id * 31 + order_id * 7 + option * 13 + place * 5) % 97) / CAST(97 AS DOUBLE)"


@query(f"""WITH perms AS (SELECT row_number() OVER (ORDER BY a, b, c, d) - 1 AS order_id, [a, b, c, d] AS o FROM range(4) x(a), range(4) y(b), range(4) z(c), range(4) w(d) WHERE a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d),
cs AS (SELECT n_nationkey AS case_id FROM nation), r AS (SELECT case_id, order_id, place, option, {_CHANCE} AS p FROM (SELECT case_id, order_id, unnest(range(4)) AS place, unnest(o) AS option FROM cs, perms)),
w AS (SELECT case_id, order_id, arg_min(option, (-p, option)) AS winner, arg_min(place, (-p, option)) AS place FROM r GROUP BY 1, 2), m AS (SELECT case_id, option, max(p) - min(p) AS spread, avg(p) AS mean FROM r GROUP BY 1, 2),
b AS (SELECT case_id, arg_min(option, (-round(mean, 12), option)) AS best, sum(spread) AS spread, count(*) AS k FROM m GROUP BY 1), c AS (SELECT case_id, count(DISTINCT winner) AS winners, max(winner) FILTER (order_id = 0) AS original, count(*) FILTER (place = 0) AS firsts, count(*) AS orders FROM w GROUP BY 1)
SELECT count(*) AS cases, max(orders) AS orders_per_case, {_ONE('winners > 1')} AS flip_rate, round(sum(firsts) / sum(orders), 6) AS first_position_wins, 0.25::DOUBLE AS chance, round(sum(spread) / sum(k), 6) AS spread, {_ONE('best = original')} AS agreement FROM c JOIN b USING (case_id)""")
def order_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of four options of each nation, with chances from their numbers."""
    cases = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("case_id"), F.array(*(F.concat("n_name", F.lit(f" {i}")) for i in range(4))).alias("candidates"))
    decisions = scores.orders(cases).withColumn("p", F.expr(_CHANCE))
    return _rounded(scores.order_bias(decisions))


_VARIANTS = {"g": "b", "w": "b", "t": "d"}


@query("""WITH p AS (SELECT p_brand AS brand, p_name AS text, min(p_partkey) AS rank FROM part GROUP BY 1, 2), f AS (SELECT *, translate(text, 'gwt', 'bbd') AS family FROM p)
SELECT brand, family, arg_min(text, rank) AS representative, string_agg(text, '|' ORDER BY rank) AS members, row_number() OVER (PARTITION BY brand ORDER BY min(rank)) - 1 AS rank FROM f GROUP BY 1, 2""")
def candidate_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names by brand, with three letters as variants of others."""
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("case_id"), F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("rank"))
    out = scores.families(rows, _VARIANTS)
    return out.select(F.col("case_id").alias("brand"), "family", "representative", F.array_join("members", "|").alias("members"), "rank")


@query("""WITH p AS (SELECT p_brand AS brand, p_name AS text, min(p_partkey) AS base, max(p_retailprice) / 1000 AS score FROM part GROUP BY 1, 2), f AS (SELECT *, translate(text, 'gwt', 'bbd') AS family FROM p),
fam AS (SELECT brand, family, arg_min(text, base) AS option, row_number() OVER (PARTITION BY brand ORDER BY min(base)) - 1 AS r FROM f GROUP BY 1, 2), asked AS MATERIALIZED (SELECT * FROM fam WHERE r < 12),
ans AS MATERIALIZED (SELECT brand, option, ((ascii(option) + len(option)) % 7 + 1) / sum((ascii(option) + len(option)) % 7 + 1) OVER (PARTITION BY brand) * CASE WHEN brand[7:7] = '3' THEN 2 ELSE 1 END AS p FROM asked WHERE NOT (brand[7:7] = '4' AND r = 1)),
j AS (SELECT brand, CASE WHEN count(*) < 2 THEN NULL WHEN count(p) < count(*) OR abs(sum(p) - 1) > 0.001 OR max(p) > 1 THEN 'invalid_probability' END AS reason, count(*) AS n FROM asked LEFT JOIN ans USING (brand, option) GROUP BY 1),
m AS (SELECT f.brand, f.text, base, CASE WHEN reason IS NULL AND n > 1 THEN p END AS p, reason FROM f LEFT JOIN asked USING (brand, family) LEFT JOIN ans ON ans.brand = f.brand AND ans.option = asked.option JOIN j ON j.brand = f.brand)
SELECT brand, text, round(p, 6) AS p, row_number() OVER (PARTITION BY brand ORDER BY p DESC NULLS LAST, base) AS rank, CASE WHEN reason IS NULL THEN 'ok' ELSE 'fallback' END AS status, reason FROM m""")
def contextual_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backend's answers for the first twelve families of each brand; two kinds of brand are answered wrongly."""
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("case_id"), F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("rank"), (F.max("p_retailprice") / 1000).alias("score"))
    families = scores.families(rows, _VARIANTS)
    asked = ranking.window(rows, families, "case_id")
    weight = (F.ascii("option") + F.length("option")) % 7 + 1
    kind = F.substring("case_id", 7, 1)
    answered = asked.filter(~((kind == "4") & (F.col("rank") == 1))).withColumn("p", weight / F.sum(weight).over(Window.partitionBy("case_id")) * F.when(kind == "3", 2).otherwise(1)).select("case_id", "option", "p", F.lit(None).cast("string").alias("error"))
    out = ranking.contextual(rows.withColumnRenamed("rank", "base"), families, answered, "case_id", "text", "score", "base")
    return out.select(F.col("case_id").alias("brand"), "text", F.round("p", 6).alias("p"), "rank", "status", "reason")


_CONFIG = "c AS (SELECT n_name AS name, count(*) > 1 AS production_eligible, round(avg(s_acctbal) / 10000, 4) AS gov, round(max(s_acctbal) / 10000, 4) AS top1, sum(s_suppkey % 7)::BIGINT AS worse FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)"


@query(f"""WITH {_CONFIG}, f AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT production_eligible THEN 'not_production_eligible' END, CASE WHEN round(0.45 - gov, 6) > 0.02 THEN 'gov_regression' END], lambda x: x IS NOT NULL), ',') AS failures FROM c),
t AS (SELECT *, failures = '' AND (SELECT max(top1) FROM f WHERE failures = '') - top1 <= 0.05 + 1e-9 AS tied FROM f)
SELECT name, failures, tied, tied AND name = (SELECT arg_min(name, (worse, -top1, name)) FROM t WHERE tied) AS selected FROM t""")
def gated_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as configurations, by their suppliers' balances."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg((F.count(F.lit(1)) > 1).alias("production_eligible"), F.round(F.avg("s_acctbal") / 10000, 4).alias("gov"), F.round(F.max("s_acctbal") / 10000, 4).alias("top1"), F.sum(F.col("s_suppkey") % 7).alias("worse"))
    out = scores.gated(rows, {"gov": 0.45}, {"gov": 0.02}, "top1", (F.col("worse"), -F.col("top1"), F.col("name")), items=20)
    return out.select("name", F.array_join("failures", ",").alias("failures"), "tied", "selected")


@query(f"""WITH {_CONFIG} SELECT name, top1 FROM c WHERE gov >= 0.4 AND worse <= 12 AND top1 >= (SELECT max(top1) FROM c WHERE gov >= 0.4 AND worse <= 12) - (0.05 + 1e-9) ORDER BY worse, name LIMIT 1""")
def selection_gate_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.round(F.avg("s_acctbal") / 10000, 4).alias("gov"), F.round(F.max("s_acctbal") / 10000, 4).alias("top1"), F.sum(F.col("s_suppkey") % 7).alias("worse"))
    return metrics.selected(rows, (F.col("gov") >= 0.4) & (F.col("worse") <= 12), "top1", (F.col("worse"), F.col("name")), width=0.05 + 1e-9).select("name", "top1")


@query("""WITH r AS (SELECT user_id AS capacity, 'same' AS signature, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1),
b AS (SELECT min(p50) FILTER (capacity > 0) AS a, min(p95) FILTER (capacity > 0) AS b, min(p99) FILTER (capacity > 0) AS c FROM r), x AS (SELECT capacity, capacity > 0 AND p50 <= a * 4 AND p95 <= b * 2 AND p99 <= c * 2 AS acceptable FROM r, b)
SELECT capacity, acceptable, acceptable AND capacity = (SELECT min(capacity) FROM x WHERE acceptable) AS selected FROM x""")
def cache_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as cache sizes, by their events' values as timings."""
    runs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("capacity")).agg(F.lit("same").alias("signature"), *(F.round(F.percentile("value", F.lit(q)), 6).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)))
    return scores.capacity(runs, {"p50": 4.0, "p95": 2.0, "p99": 2.0}).select("capacity", "acceptable", "selected")


# Evaluation sets

_CLAUSES = f"""s AS (SELECT 's' || (conv_id % 4)::VARCHAR AS source_id, conv_id AS doc_id, role AS domain, {sql_han('text')} AS text FROM conversations),
cut AS (SELECT *, regexp_extract_all(text, '[一-鿿]+') AS runs FROM s),
clauses AS (SELECT source_id, doc_id, domain, text, clause, sha256(source_id || chr(0) || doc_id::VARCHAR || chr(0) || clause) AS key FROM (SELECT *, unnest(runs) AS clause FROM cut) WHERE len(clause) BETWEEN 4 AND 10),
ann AS (SELECT clause, array_to_string(list_transform(string_split(clause, ''), lambda c: CASE WHEN contains('{VOWELS}', c) THEN 'q' ELSE 'r' END || c), ' ') AS readings FROM (SELECT DISTINCT clause FROM clauses) WHERE NOT regexp_matches(clause, '[{VOWELS.replace(RATED, '')}]'))"""


def _evidence(spark: SparkSession, sf_dir: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only the rated vowel is settled, and no words are known: other vowels refuse a clause."""
    rated = rated_words(spark, known_words(spark, sf_dir)).filter("length(text) = 1")
    return annotation.char_evidence(char_readings(rows), rated), annotation.word_evidence(rated)


def _annotated(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return annotation.annotated(sets.clauses(rows, 4, 10).select(F.col("clause").alias("text")), *_evidence(spark, sf_dir, rows), 2)


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("s"), F.col("conv_id") % 4).alias("source_id"), F.col("conv_id").alias("doc_id"), F.col("role").alias("domain"), han("text").alias("text"))


def _settled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A clause once a document and role, with what stands before it left out of the order, and the clauses' readings:
    those with a character that refuses them go where their turn is read, the others are written once."""
    rows = _sentences(spark, sf_dir)
    chars, words = _evidence(spark, sf_dir, rows)
    chars = written(chars, "characters")
    each = sets.clauses(rows, 4, 10).select("source_id", "doc_id", "domain", F.col("clause").alias("text"))
    fit = written(annotation.readable(each, chars, words).distinct(), "clauses")
    return fit, annotation.annotated(fit, chars, words, 2)


@query(f"WITH {_CLAUSES} SELECT DISTINCT source_id || ':' || left(key, 12) AS item_id, 'silver:' || domain AS origin, readings, clause AS gold FROM (SELECT *, dense_rank() OVER (PARTITION BY domain ORDER BY key) AS r FROM clauses JOIN ann USING (clause)) WHERE r <= 20")
def silver_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the sample: the twenty first annotated clauses of each role by hash (a clause that stands twice in a
    document is one here)."""
    out = sets.silver(*_settled(spark, sf_dir), "domain", 20)
    return out.select("item_id", "origin", F.array_join("readings", " ").alias("readings"), "gold").distinct()


@query(f"""WITH {_CLAUSES} SELECT domain, CASE WHEN readings IS NOT NULL THEN 'accepted' ELSE 'ambiguous' END AS outcome, count(*) AS n FROM clauses LEFT JOIN ann USING (clause) GROUP BY 1, 2""")
def silver_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir)
    return sets.refusals(rows, _annotated(spark, sf_dir, rows), "domain")


@query(f"""WITH {_CLAUSES}, each AS (SELECT DISTINCT source_id, doc_id, domain, clause, key, readings FROM clauses JOIN ann USING (clause) WHERE domain <> 'system' AND clause NOT IN (SELECT clause FROM clauses WHERE domain = 'system')), d AS (SELECT *, row_number() OVER (PARTITION BY domain, source_id, doc_id ORDER BY key) AS d FROM each),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY key) AS r FROM d WHERE d <= 2) SELECT 'gov:' || source_id || ':' || left(key, 12) AS item_id, domain AS category, clause AS text, readings, source_id, doc_id FROM r WHERE r <= 30""")
def formal_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the sample: two clauses a document and thirty a role by hash; system turns count as training texts."""
    rows, annotations = _settled(spark, sf_dir)
    out = sets.formal_set(rows.filter("domain <> 'system'"), annotations, rows.filter("domain = 'system'"), "domain", 30, 2, 4, 10)
    return out.select("item_id", "category", "text", F.array_join("readings", " ").alias("readings"), "source_id", "doc_id")


@query(f"""WITH {_CLAUSES}, i AS (SELECT DISTINCT clause, list_transform(string_split(clause, ''), lambda c: CASE WHEN contains('{VOWELS}', c) THEN 'q' ELSE 'x' END || c) AS readings FROM clauses)
SELECT clause AS item_id, 'reading' AS issue, (k - 1)::INT AS position FROM (SELECT clause, readings, unnest(range(1, len(clause) + 1)) AS k FROM i) WHERE readings[k][1:1] = 'x'""")
def reading_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses whose consonants have readings that no character has."""
    rows = _sentences(spark, sf_dir)
    items = sets.clauses(rows, 4, 10).select(F.col("clause").alias("text")).distinct()
    read = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.concat(F.when(F.instr(F.lit(VOWELS), c) > 0, "q").otherwise("x"), c))
    return annotation.reading_issues(items.select(F.col("text").alias("item_id"), "text", read.alias("readings"), F.array("text").alias("acceptable")), char_readings(rows))
