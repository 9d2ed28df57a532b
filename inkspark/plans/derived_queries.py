"""Queries of derived lexicons: slices of conversations by role, their candidates, readings, filters, recipes, ranks.

The driver's tables have no Han text, so letters stand as Han characters, one for one, and the operators run with their
own script. A letter's reading is r and the letter; vowels have a second one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.operators import annotation, derived, metrics
from inkspark.plans.registry import query, table
from inkspark.sources.shared import spread, written

LETTERS, HAN = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + i) for i in range(26))
VOWELS = "".join(HAN[LETTERS.index(c)] for c in "aeiou")
RATED = HAN[LETTERS.index("e")]
EVERYDAY, WEIGHTS = "user", {"assistant": 0.7, "system": 0.3}


def han(text: str):
    return F.translate(F.lower(F.col(text)), LETTERS, HAN)


def sql_han(text: str) -> str:
    return f"translate(lower({text}), '{LETTERS}', '{HAN}')"


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations")).select(F.col("role").alias("slice"), F.concat(F.lit("s"), F.col("conv_id") % 4).alias("source"), F.col("conv_id").alias("doc"), han("text").alias("text"))


def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text: words of two to four letters in benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(han("text"), F.lit("[一-鿿]+"), F.lit(0))).alias("text")).filter("length(text) between 2 and 4").distinct()


def char_readings(rows: DataFrame) -> DataFrame:
    """char, reading, order of the letters of `rows` (text)."""
    chars = rows.select(F.explode(F.array_distinct(F.split("text", ""))).alias("char")).filter("char between '一' and '鿿'").distinct()
    return chars.select("char", F.explode(F.when(F.instr(F.lit(VOWELS), F.col("char")) > 0, F.array(F.concat(F.lit("q"), "char"), F.concat(F.lit("r"), "char"))).otherwise(F.array(F.concat(F.lit("r"), "char")))).alias("reading")).withColumn("order", F.lit(0))


def rated_words(spark: SparkSession, words: DataFrame) -> DataFrame:
    """text, readings: the known words by r readings, and one vowel whose q reading is given."""
    own = words.select("text", F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.concat(F.lit("r"), c)).alias("readings"))
    return own.unionByName(spark.createDataFrame([(RATED, ["q" + RATED])], "text string, readings array<string>"))


def _stats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, known = sentences(spark, sf_dir), known_words(spark, sf_dir)
    counts = written(derived.slice_counts(rows), "slice-counts")
    return written(derived.statistics(rows, counts, known, EVERYDAY, WEIGHTS), "candidates"), counts, known


def _readings(spark: SparkSession, rows: DataFrame, known: DataFrame, texts: DataFrame, policy: str) -> DataFrame:
    """text, readings (array of sequences)."""
    chars, words = annotation.char_evidence(char_readings(rows), rated_words(spark, known)), annotation.word_evidence(rated_words(spark, known))
    if policy == "cartesian":
        return annotation.combined(texts, chars, words, 4, char_readings(rows)).filter("readings is not null")
    return annotation.annotated(texts, chars, words, 4, policy, checked=False).filter("readings is not null").select("text", F.array("readings").alias("readings"))


_EACH = "\n  UNION ALL ".join(f"SELECT slice, source, doc, unnest(list_transform(range(1, len(run) - {n} + 2), lambda i: run[i : i + {n - 1}])) AS gram FROM pieces" for n in (1, 2, 3, 4))
_TABLES = f"""s AS (SELECT role AS slice, 's' || (conv_id % 4)::VARCHAR AS source, conv_id AS doc, {sql_han('text')} AS text FROM conversations),
pieces AS (SELECT slice, source, doc, unnest(regexp_extract_all(text, '[一-鿿]+')) AS run FROM s),
each AS ({_EACH}),
counts AS (SELECT slice, gram, len(gram) AS n, count(*) AS c FROM each GROUP BY 1, 2 HAVING len(gram) = 1 OR count(*) >= 2),
totals AS (SELECT slice, sum(c) AS total FROM counts WHERE n = 1 GROUP BY 1),
w(slice, weight) AS (VALUES ('assistant', 0.7::DOUBLE), ('system', 0.3::DOUBLE)),
sums AS (SELECT sum(total) AS a, sum(total) FILTER (slice = 'user') AS b FROM totals),
tab AS (SELECT n, gram, sum(c) AS pooled, coalesce(sum(c) FILTER (slice = 'user'), 0) AS everyday, sum(coalesce(weight, 0) * c / total) AS weighted_p FROM counts JOIN totals USING (slice) LEFT JOIN w USING (slice) GROUP BY 1, 2),
p AS (SELECT n, gram, pooled, everyday, pooled / a AS pooled_p, everyday / b AS everyday_p, weighted_p FROM tab, sums),
known AS (SELECT DISTINCT k FROM (SELECT unnest(regexp_extract_all({sql_han('text')}, '[一-鿿]+')) AS k FROM benchmark) WHERE len(k) BETWEEN 2 AND 4)"""


def _sql_pmi(name: str, wanted: str, p: str) -> str:
    return f"""{name} AS (SELECT gram, min(CASE WHEN j.x > 0 AND l.x > 0 AND r.x > 0 THEN log2(j.x / (l.x * r.x)) ELSE '-inf'::DOUBLE END) AS {name}
  FROM (SELECT gram, unnest(range(1, len(gram))) AS k FROM {wanted}) cuts JOIN (SELECT gram, {p} AS x FROM p) j USING (gram)
  LEFT JOIN (SELECT gram AS g, {p} AS x FROM p) l ON l.g = gram[1 : k] LEFT JOIN (SELECT gram AS g, {p} AS x FROM p) r ON r.g = gram[k + 1 :] GROUP BY 1)"""


def _sql_share(name: str, count: str) -> str:
    return f"""{name} AS (SELECT gram, coalesce(best, 0) / {count} AS {name} FROM p LEFT JOIN (SELECT g, max(c) AS best FROM (
  SELECT gram[1 : n - 1] AS g, {count} AS c FROM p WHERE n > 2 UNION ALL SELECT gram[2 :], {count} FROM p WHERE n > 2) GROUP BY 1) ON g = gram WHERE n IN (2, 3) AND {count} > 0)"""


_NUMERAL = f"contains('{derived.NUMERALS}', x)"
_STATS = f"""WITH RECURSIVE {_TABLES},
cand AS (SELECT * FROM p WHERE n > 1 AND (pooled_p >= 2e-6 OR everyday >= 3) AND gram NOT IN (SELECT k FROM known)),
{_sql_pmi('pooled_pmi', 'cand', 'pooled_p')}, {_sql_pmi('everyday_pmi', 'cand', 'everyday_p')},
{_sql_share('fragment', 'pooled')}, {_sql_share('everyday_fragment', 'everyday')},
spots AS (SELECT slice, source, doc, text, n, unnest(range(1, len(text) - n + 2)) AS i FROM s, (VALUES (2), (3), (4)) z(n)),
hits AS (SELECT slice, source, doc, text[i : i + n - 1] AS gram, (i > 1 AND contains('{derived.NUMERALS}', text[i - 1 : i - 1])) OR (i + n <= len(text) AND contains('{derived.NUMERALS}', text[i + n : i + n])) AS numeral FROM spots),
occ AS (SELECT gram, count(*) AS "count", count(DISTINCT (source, doc)) AS documents, count(DISTINCT (source, doc)) FILTER (slice = 'user') AS everyday_documents, count(*) FILTER (numeral) AS numeral_adjacent, count(DISTINCT source) AS sources FROM hits SEMI JOIN cand USING (gram) GROUP BY 1),
rates AS (SELECT gram, slice, count(*) / total AS rate FROM hits SEMI JOIN cand USING (gram) JOIN totals USING (slice) GROUP BY gram, slice, total),
tops AS (SELECT gram, arg_min(slice, (-rate, slice)) AS top_slice, max(rate) / sum(rate) AS top_share FROM rates GROUP BY 1),
stats AS (SELECT cand.*, pooled_pmi, everyday_pmi, coalesce(fragment, 0) AS fragment, coalesce(everyday_fragment, 0) AS everyday_fragment, coalesce("count", 0) AS "count", coalesce(documents, 0) AS documents, coalesce(everyday_documents, 0) AS everyday_documents,
  coalesce(numeral_adjacent / "count", 0) AS numeral_share, coalesce(sources, 0) AS sources, top_slice, top_share, 0.25 * everyday_p + 0.75 * weighted_p AS interpolated_p
  FROM cand JOIN pooled_pmi USING (gram) JOIN everyday_pmi USING (gram) LEFT JOIN fragment USING (gram) LEFT JOIN everyday_fragment USING (gram) LEFT JOIN occ USING (gram) LEFT JOIN tops USING (gram))"""


@query(f"WITH {_TABLES} SELECT n, gram, pooled::BIGINT AS pooled, everyday::BIGINT AS everyday, round(1e6 * pooled_p, 4) AS pooled_m, round(1e6 * everyday_p, 4) AS everyday_m, round(1e6 * weighted_p, 4) AS weighted_m FROM p")
def pooled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derived.pooled(derived.slice_counts(sentences(spark, sf_dir)), EVERYDAY, WEIGHTS)
    return out.select("n", "gram", "pooled", "everyday", *(F.round(1e6 * F.col(f"{c}_p"), 4).alias(f"{c}_m") for c in ("pooled", "everyday", "weighted")))


@query(f"""{_STATS} SELECT gram, round(pooled_pmi, 4) AS pooled_pmi, CASE WHEN isinf(everyday_pmi) THEN NULL ELSE round(everyday_pmi, 4) END AS everyday_pmi, round(fragment, 6)::DOUBLE AS fragment, round(everyday_fragment, 6)::DOUBLE AS everyday_fragment, "count", documents, everyday_documents,
round(numeral_share, 6)::DOUBLE AS numeral_share, sources, top_slice, round(top_share, 6) AS top_share FROM stats""")
def candidate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, _, _ = _stats(spark, sf_dir)
    return stats.select("gram", F.round("pooled_pmi", 4).alias("pooled_pmi"), F.when(F.col("everyday_pmi") > float("-inf"), F.round("everyday_pmi", 4)).alias("everyday_pmi"), F.round("fragment", 6).alias("fragment"), F.round("everyday_fragment", 6).alias("everyday_fragment"), "count", "documents", "everyday_documents", F.round("numeral_share", 6).alias("numeral_share"), F.coalesce(F.size("sources"), F.lit(0)).alias("sources"), "top_slice", F.round("top_share", 6).alias("top_share"))


_MIXED = "CASE WHEN pooled_p < 2e-6 THEN 'below_pooled_frequency' WHEN documents < 2 THEN 'too_few_documents' WHEN fragment >= 0.9 THEN 'fragment_of_longer_ngram' END"
_EVERYDAY = "CASE WHEN everyday < 3 THEN 'below_everyday_count' WHEN everyday_documents < 3 THEN 'too_few_everyday_documents' WHEN everyday_pmi < 3 THEN 'low_everyday_pmi' WHEN everyday_fragment >= 0.9 THEN 'fragment_of_longer_ngram' END"
_FILTERS = {
    "mixed": _MIXED, "everyday_only": _EVERYDAY, "everyday_supported": f"coalesce({_MIXED}, CASE WHEN everyday_documents < 2 THEN 'no_everyday_support' END)",
    "slice_ratio": f"coalesce({_MIXED}, CASE WHEN top_slice <> 'user' AND top_share >= 0.8 THEN 'one_slice_concentrated' WHEN numeral_share >= 0.5 THEN 'numeral_template' END)",
    "document_frequency": f"coalesce({_MIXED}, CASE WHEN documents < 5 THEN 'too_few_documents' WHEN sources < 3 THEN 'too_few_sources' END)",
}


@query(f"{_STATS} SELECT gram, {', '.join(f'{c} AS {k}' for k, c in _FILTERS.items())} FROM stats")
def extraction_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, _, _ = _stats(spark, sf_dir)
    return stats.select("gram", *(c.alias(k) for k, c in derived.filters(EVERYDAY).items()))


def _sql_annotated(texts: str, name: str, singles: bool) -> str:
    """text, readings of `texts` (text): known words first, then characters with one reading (and rated ones)."""
    return f"""{name}_at AS (SELECT text, i, max(n) AS n FROM (SELECT text, unnest(range(1, len(text) + 1)) AS i FROM {texts}), (VALUES (2), (3), (4)) z(n) WHERE i + n - 1 <= len(text) AND text[i : i + n - 1] IN (SELECT k FROM known) GROUP BY 1, 2),
{name}_path(text, spot, readings) AS (SELECT text, 1::BIGINT, []::VARCHAR[] FROM {texts}
  UNION ALL SELECT q.text, spot + coalesce(n, 1), CASE WHEN n IS NOT NULL THEN list_concat(readings, list_transform(string_split(q.text[spot : spot + n - 1], ''), lambda c: 'r' || c))
    WHEN contains('{VOWELS}', q.text[spot : spot]) THEN list_append(readings, 'q' || q.text[spot : spot]) ELSE list_append(readings, 'r' || q.text[spot : spot]) END
  FROM {name}_path q LEFT JOIN {name}_at h ON h.text = q.text AND h.i = spot WHERE spot <= len(q.text) AND (n IS NOT NULL OR NOT contains('{VOWELS}', q.text[spot : spot]){f" OR q.text[spot : spot] = '{RATED}'" if singles else ''})),
{name} AS (SELECT text, array_to_string(readings, ' ') AS reading FROM {name}_path WHERE spot = len(text) + 1)"""


_RECIPE = f"""{_STATS}, texts AS (SELECT gram AS text FROM cand), {_sql_annotated('texts', 'ann', True)},
kept AS (SELECT stats.*, reading FROM stats JOIN ann ON text = gram WHERE ({_FILTERS['mixed']}) IS NULL),
entries AS (SELECT gram AS text, reading, "count", documents, pooled_pmi, pooled_p, CASE WHEN interpolated_p > 0 THEN least(greatest(10 * interpolated_p / (SELECT median(interpolated_p) FROM kept WHERE interpolated_p > 0), 3), 200) ELSE 3 END AS weight FROM kept)"""


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    stats, _, known = _stats(spark, sf_dir)
    rows = sentences(spark, sf_dir)
    readings = _readings(spark, rows, known, stats.select(F.col("gram").alias("text")), "bounded")
    return derived.recipe(stats, readings, "mixed", "interpolated", EVERYDAY), rows, known


@query(f'{_RECIPE} SELECT text, reading, "count", documents, round(pooled_pmi, 4) AS pmi, round(1e6 * pooled_p, 4) AS per_million, round(weight, 4)::DOUBLE AS weight FROM entries')
def lexicon_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded readings, the mixed filter and the interpolated prior."""
    entries, _, _ = _entries(spark, sf_dir)
    return entries.select("text", F.array_join(F.element_at("readings", 1), " ").alias("reading"), "count", "documents", "pmi", "per_million", "weight")


@query(f"""{_STATS}, texts AS (SELECT gram AS text FROM cand), {_sql_annotated('texts', 'ann', False)}
SELECT reason, count(*) AS n FROM (SELECT coalesce({_FILTERS['document_frequency']}, CASE WHEN reading IS NULL THEN 'readings_unresolved' END) AS reason FROM stats LEFT JOIN ann ON text = gram) WHERE reason IS NOT NULL GROUP BY 1""")
def recipe_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, _, known = _stats(spark, sf_dir)
    readings = _readings(spark, sentences(spark, sf_dir), known, stats.select(F.col("gram").alias("text")), "known_word")
    return derived.rejections(stats, readings, "document_frequency", EVERYDAY)


@query(f"""{_STATS}, frequent AS (SELECT *, 0.25 * everyday_p + 0.75 * weighted_p AS q FROM p WHERE n > 1 AND 0.25 * everyday_p + 0.75 * weighted_p >= 2e-6),
{_sql_pmi('pmi', 'frequent', '0.25 * everyday_p + 0.75 * weighted_p')}, texts AS (SELECT gram AS text FROM frequent), {_sql_annotated('texts', 'ann', True)},
combos AS (SELECT text, list_product(list_transform(string_split(text, ''), lambda c: CASE WHEN contains('{VOWELS}', c) THEN 2 ELSE 1 END)) AS ways FROM texts),
docs AS (SELECT gram, count(*) AS "count", count(DISTINCT (source, doc)) AS documents FROM each SEMI JOIN frequent USING (gram) GROUP BY 1),
judged AS (SELECT f.gram, coalesce(d."count", 0) AS "count", coalesce(d.documents, 0) AS documents, pmi, q * 1e6 AS per_million, CASE WHEN f.gram IN (SELECT k FROM known) THEN 'known_word' WHEN coalesce(d.documents, 0) < 2 THEN 'too_few_documents' WHEN pmi < 0 THEN 'low_pmi'
  WHEN coalesce(fragment, 0) >= 0.9 THEN 'fragment_of_longer_ngram' WHEN reading IS NULL AND ways > 4 THEN 'readings_unresolved' ELSE 'eligible' END AS eligibility
  FROM frequent f JOIN pmi USING (gram) LEFT JOIN fragment USING (gram) LEFT JOIN docs d USING (gram) LEFT JOIN ann ON ann.text = f.gram JOIN combos ON combos.text = f.gram)
SELECT gram AS text, "count", documents, round(pmi, 4) AS pmi, round(per_million, 4) AS per_million, round(least(greatest(10 * per_million / (SELECT median(per_million) FROM judged WHERE eligibility = 'eligible'), 3), 200), 4)::DOUBLE AS weight, eligibility FROM judged""".replace("list_product(", "list_reduce(").replace("ELSE 1 END)) AS ways", "ELSE 1 END), lambda a, b: a * b) AS ways"))
def extraction_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interpolated estimator, with up to four reading combinations where the annotation is open."""
    rows, known = sentences(spark, sf_dir), known_words(spark, sf_dir)
    counts = written(derived.slice_counts(rows), "slice-counts")
    return derived.extracted(rows, counts, known, lambda texts: _readings(spark, rows, known, texts, "cartesian"), EVERYDAY, WEIGHTS, derived.interpolated()).drop("readings")


_LEXICON = f"""{_RECIPE}, base AS (SELECT k AS text, array_to_string(list_transform(string_split(k, ''), lambda c: 'r' || c), ' ') AS reading, 50.0::DOUBLE AS frequency FROM known),
lexicon AS (SELECT * FROM base UNION ALL SELECT text, reading, round(weight, 4)::DOUBLE FROM entries ANTI JOIN base USING (text, reading))"""


def _base(known: DataFrame) -> DataFrame:
    return known.select("text", F.array_join(F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.concat(F.lit("r"), c)), " ").alias("reading"), F.lit(50.0).alias("frequency"))


@query(f"{_LEXICON} SELECT text, reading, frequency FROM lexicon")
def joined_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, _, known = _entries(spark, sf_dir)
    return derived.joined_lexicon(_base(known), entries)


#: Readings that fold vowels together, so that words share them: what homophones are compared by.
def _folded(reading: str):
    return F.translate(F.col(reading), VOWELS, VOWELS[0] * len(VOWELS))


_FOLD = f"translate(reading, '{VOWELS}', '{VOWELS[0] * len(VOWELS)}')"


@query(f"""{_LEXICON}, e AS (SELECT text, {_FOLD} AS reading FROM entries), b AS (SELECT text AS other, {_FOLD} AS reading, frequency FROM base)
SELECT text, reading, count(*) AS competitors, arg_min(other, (-frequency, other)) AS best FROM e JOIN b USING (reading) WHERE other <> text AND len(other) = len(text) GROUP BY 1, 2""")
def homophone_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, _, known = _entries(spark, sf_dir)
    folded = entries.withColumn("readings", F.array(F.split(F.translate(F.array_join(F.element_at("readings", 1), " "), VOWELS, VOWELS[0] * len(VOWELS)), " ")))
    return derived.homophones(folded, _base(known).withColumn("reading", _folded("reading")))


@query(f"""{_LEXICON}, l AS (SELECT text, {_FOLD} AS reading, frequency FROM lexicon), g AS (SELECT text AS word, {_FOLD} AS reading FROM base),
o AS (SELECT word, g.reading, count(*) AS m, max(frequency) FILTER (text = word) AS own FROM g JOIN l ON l.reading = g.reading AND len(text) = len(word) GROUP BY 1, 2)
SELECT word, o.reading, m > 1 AS contested, 1 + count(*) FILTER (frequency > own OR (frequency = own AND text < word)) AS rank FROM o JOIN l ON l.reading = o.reading AND len(text) = len(word) GROUP BY word, o.reading, m""")
def gold_word_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, _, known = _entries(spark, sf_dir)
    lexicon = derived.joined_lexicon(_base(known), entries).withColumn("reading", _folded("reading"))
    gold = _base(known).select(F.col("text").alias("word"), _folded("reading").alias("reading"))
    return derived.gold_ranks(gold, lexicon)


@query(f"""{_LEXICON}, bare AS (SELECT text, {_FOLD} AS reading FROM entries WHERE text NOT IN (SELECT text FROM texts WHERE regexp_matches(text, '^[^{VOWELS}]+$'))),
o AS (SELECT DISTINCT text, {_FOLD} AS reading FROM base UNION SELECT text, {_FOLD} FROM entries)
SELECT count(*) AS unsupported, count(*) FILTER (rivals > 0) AS competing FROM (SELECT bare.text, bare.reading, count(*) FILTER (o.text <> bare.text AND len(o.text) = len(bare.text)) AS rivals FROM bare LEFT JOIN o USING (reading) GROUP BY 1, 2)""")
def false_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived words with a character of several readings, and those that another word of the reading competes with."""
    entries, rows, known = _entries(spark, sf_dir)
    entries = written(entries, "entries")
    fold = lambda c: F.transform(c, lambda s: F.transform(s, lambda r: F.translate(r, VOWELS, VOWELS[0] * len(VOWELS))))
    fine = _readings(spark, rows, known, entries.select("text"), "unambiguous")
    return derived.false_competitors(entries.withColumn("readings", fold("readings")), fine.withColumn("readings", fold("readings")), _base(known).withColumn("reading", _folded("reading")))


@query(f"""{_RECIPE}, v AS (SELECT list_sort(list(round(weight, 4)::DOUBLE)) AS l, count(*) - 1 AS m FROM entries)
SELECT l[1] AS "min", l[round_even(0.25 * m, 0)::INT + 1] AS p25, l[round_even(0.5 * m, 0)::INT + 1] AS median, l[round_even(0.75 * m, 0)::INT + 1] AS p75, l[m + 1] AS "max" FROM v WHERE m >= 0""")
def weight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, _, _ = _entries(spark, sf_dir)
    return metrics.weight_summary(entries, "weight")


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, {sql_han('text')} AS text FROM documents), vocabulary AS (SELECT DISTINCT k FROM (SELECT unnest(regexp_extract_all({sql_han('text')}, '[一-鿿]+')) AS k FROM benchmark) WHERE len(k) BETWEEN 2 AND 4),
ks AS (SELECT text, count(*) AS copies FROM (SELECT unnest(regexp_extract_all(text, '[一-鿿]+')) AS text FROM t) GROUP BY 1),
marks AS (SELECT text, i, max(n) AS n FROM (SELECT text, unnest(range(1, len(text) + 1)) AS i FROM ks), (VALUES (2), (3), (4)) z(n) WHERE i + n - 1 <= len(text) AND text[i : i + n - 1] IN (SELECT k FROM vocabulary) GROUP BY 1, 2),
path(text, copies, spot, word) AS (SELECT text, copies, 1::BIGINT, '' FROM ks UNION ALL SELECT p.text, copies, spot + coalesce(n, 1), p.text[spot : spot + coalesce(n, 1) - 1] FROM path p LEFT JOIN marks ON marks.text = p.text AND marks.i = spot WHERE spot <= len(p.text))
SELECT word, sum(copies)::BIGINT AS c FROM path WHERE word <> '' GROUP BY 1""")
def segmented_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match words within the runs of letters of all documents."""
    runs = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(han("text"), F.lit("[一-鿿]+"), F.lit(0))).alias("text"))
    return annotation.counted_words(runs, known_words(spark, sf_dir).withColumnRenamed("text", "word"), 4)
