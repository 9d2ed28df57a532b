"""Queries of decoding, guards and near-duplicates on cases made from the driver's rows.

Cases are words of benchmark items, typed on a keypad of eight keys: a letter's reading is its key, so that every key
has three or four letters, and the lexicon and the language model come from conversations. Letters stand as Han
characters, one for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.operators import corpus, decoding, guards, lattice, lexicons, models, ngrams, scores
from inkspark.plans.derived_queries import HAN, known_words, sql_han, han
from inkspark.plans.registry import query, table
from inkspark.sources.shared import spread, written

#: Keys of the letters in order, as on telephones.
KEYS = "22233344455566677778889999"
WIDE = decoding.Settings(beam=100_000, nbest=100_000)


def _typed(text: str):
    return F.filter(F.split(F.translate(text, HAN, KEYS), ""), lambda c: c != "")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id (the gold text), readings."""
    return known_words(spark, sf_dir).select(F.col("text").alias("case_id"), _typed("text").alias("readings"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations")).select(han("text").alias("text"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reading, rank, text, log10_p, frequency: letters, and words of two to four that stand twice or more."""
    runs = _texts(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[一-鿿]+"), F.lit(0))).alias("text"))
    letters = runs.select(F.explode(F.regexp_extract_all("text", F.lit("[一-鿿]"), F.lit(0))).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("frequency"))
    words = runs.filter("length(text) between 2 and 4").groupBy("text").agg(F.count(F.lit(1)).alias("frequency")).filter("frequency > 1")
    every = letters.unionByName(words).select("text", F.array_join(_typed("text"), " ").alias("reading"), F.col("frequency").cast("double").alias("frequency"))
    return written(lexicons.indexed(every), "entries")


def _model(counts: DataFrame):
    return lambda grams: models.witten_bell(grams, counts)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(ngrams.counted(_texts(spark, sf_dir)), "counts")


_LEXICON = f"""texts AS (SELECT {sql_han('text')} AS text FROM conversations),
runs AS (SELECT unnest(regexp_extract_all(text, '[一-鿿]+')) AS run FROM texts),
every AS (SELECT run AS text, count(*)::DOUBLE AS frequency FROM runs WHERE len(run) BETWEEN 2 AND 4 GROUP BY 1 HAVING count(*) > 1
  UNION ALL SELECT c, count(*)::DOUBLE FROM (SELECT unnest(string_split(run, '')) AS c FROM runs) GROUP BY 1),
entries AS (SELECT text, len(text) AS size, translate(text, '{HAN}', '{KEYS}') AS keys, log10(frequency / (SELECT sum(frequency) FROM every)) AS log10_p, row_number() OVER (PARTITION BY translate(text, '{HAN}', '{KEYS}') ORDER BY frequency DESC, text) AS rank FROM every),
cases AS (SELECT DISTINCT k AS case_id, translate(k, '{HAN}', '{KEYS}') AS keys FROM (SELECT unnest(regexp_extract_all({sql_han('text')}, '[一-鿿]+')) AS k FROM benchmark) WHERE len(k) BETWEEN 2 AND 4)"""
_PATHS = """paths AS (SELECT case_id, keys, 1::BIGINT AS spot, '' AS text, 0.0::DOUBLE AS lexical, 0 AS segments FROM cases
  UNION ALL SELECT q.case_id, q.keys, spot + e.size, q.text || e.text, lexical + e.log10_p, segments + 1 FROM paths q JOIN entries e ON q.keys[spot : spot + e.size - 1] = e.keys {only}),
whole AS (SELECT case_id, text, max(lexical) AS lexical, arg_max(segments, (lexical, -segments)) AS segments FROM paths WHERE spot = len(keys) + 1 GROUP BY 1, 2)"""
_SPACE = r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_TOKENS = rf"list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]+(?:[.,][0-9]+)*', '0', 'g'), '[A-Za-z]+', 'A', 'g'), '[{_SPACE}^$]', '', 'g'), ''), lambda t: t <> '')"
_WB = f"""spots AS (SELECT t, unnest(range(3, len(t) + 1)) AS i FROM (SELECT list_concat(['^', '^'], {_TOKENS}, ['$']) AS t FROM texts)),
grams AS (SELECT 1 AS n, t[i] AS gram, count(*) AS c FROM spots GROUP BY 2 UNION ALL SELECT 2, t[i - 1] || t[i], count(*) FROM spots GROUP BY 2 UNION ALL SELECT 3, t[i - 2] || t[i - 1] || t[i], count(*) FROM spots GROUP BY 2),
followers AS (SELECT gram[1 : n - 1] AS history, sum(c)::BIGINT AS total, count(*) AS types FROM grams WHERE n > 1 GROUP BY 1),
size AS (SELECT sum(c) AS total, count(*) AS v FROM grams WHERE n = 1),
hit AS (SELECT DISTINCT text, i, ('^^' || text)[i : i + 2] AS g3 FROM (SELECT DISTINCT text, unnest(range(1, len(text) + 1)) AS i FROM whole)),
p1 AS (SELECT text, i, g3, (coalesce(c, 0) + 1) / (total + v)::DOUBLE AS p FROM hit LEFT JOIN grams ON n = 1 AND gram = g3[3:3], size),
p2 AS (SELECT text, i, g3, CASE WHEN total IS NULL THEN p ELSE (coalesce(c, 0) + types * p) / (total + types) END AS p FROM p1 LEFT JOIN grams ON n = 2 AND gram = g3[2:3] LEFT JOIN followers ON history = g3[2:2]),
p3 AS (SELECT text, i, CASE WHEN total IS NULL THEN p ELSE (coalesce(c, 0) + types * p) / (total + types) END AS p FROM p2 LEFT JOIN grams ON n = 3 AND gram = g3 AND c > 1 LEFT JOIN followers ON history = g3[1:2]),
spoken AS (SELECT text, sum(log10(p)) AS corpus FROM p3 GROUP BY 1)"""


@query(f"WITH {_LEXICON} SELECT text, keys AS reading, rank, round(log10_p, 6) AS log10_p FROM entries")
def lexicon_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("text", F.replace("reading", F.lit(" "), F.lit("")).alias("reading"), "rank", F.round("log10_p", 6).alias("log10_p"))


@query(f"WITH RECURSIVE {_LEXICON}, {_PATHS.format(only='AND e.rank <= 5')} SELECT case_id, text, round(lexical, 6) AS score, segments FROM whole")
def kbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of each case under the lexicon's own chances, five entries a span; the beam takes them all."""
    out = lattice.decoded(_cases(spark, sf_dir), _entries(spark, sf_dir), longest=4, beam=100_000)
    return out.select("case_id", "text", F.round("score", 6).alias("score"), "segments")


@query(f"""WITH RECURSIVE {_LEXICON}, words AS (SELECT * FROM entries WHERE size > 1), ends AS (SELECT case_id, keys, 1::BIGINT AS spot FROM cases UNION SELECT q.case_id, q.keys, spot + size FROM ends q JOIN words e ON q.keys[spot : spot + size - 1] = e.keys)
SELECT case_id, bool_or(spot = len(keys) + 1) AS reachable FROM ends GROUP BY 1""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether words of two letters and more cover a case."""
    return lattice.reachable(_cases(spark, sf_dir), _entries(spark, sf_dir).filter("length(text) > 1"), longest=4)


@query(f"WITH RECURSIVE {_LEXICON}, {_PATHS.format(only='')}, {_WB} SELECT case_id, text, round(lexical, 6) AS lexical, round(corpus, 6) AS corpus, round(lexical + corpus, 6) AS total FROM whole JOIN spoken USING (text)")
def lattice_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All complete texts of each case by lexicon and trigram model; the beam takes them all."""
    out = decoding.decoded(_cases(spark, sf_dir), _entries(spark, sf_dir), 4, _model(_counts(spark, sf_dir)), WIDE)
    return out.select("case_id", "text", *(F.round(c, 6).alias(c) for c in ("lexical", "corpus", "total")))


@query(f"""WITH RECURSIVE {_LEXICON}, {_PATHS.format(only='')}, {_WB}, ranked AS (SELECT case_id, text, row_number() OVER (PARTITION BY case_id ORDER BY round(lexical + corpus, 9) DESC, text) - 1 AS r FROM whole JOIN spoken USING (text))
SELECT count(*) AS n, round(avg((hit < 1)::INT), 6) AS recall_1, round(avg((hit < 5)::INT), 6) AS recall_5, round(avg((hit < 10)::INT), 6) AS recall_10 FROM (SELECT cases.case_id, coalesce(min(r), 1000000) AS hit FROM cases LEFT JOIN ranked ON ranked.case_id = cases.case_id AND text = cases.case_id GROUP BY 1)""")
def decoding_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decoding.decoded(_cases(spark, sf_dir), _entries(spark, sf_dir), 4, _model(_counts(spark, sf_dir)), WIDE)
    gold = _cases(spark, sf_dir).select("case_id", F.col("case_id").alias("target"))
    got = scores.recall_at(gold, out.select("case_id", (F.col("rank") - 1).alias("rank"), "text"))
    return got.select("n", *(F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in (1, 5, 10)))


@query()
def lattice_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a beam of three: where each gold text was lost, and its rank among all complete ones."""
    states = decoding.search(_cases(spark, sf_dir), _entries(spark, sf_dir), 4, _model(_counts(spark, sf_dir)), decoding.Settings(beam=3))
    return decoding.traced(states, _cases(spark, sf_dir).select("case_id", F.col("case_id").alias("text")))


@query(f"""WITH RECURSIVE {_LEXICON}, {_PATHS.format(only='')}, single AS (SELECT c.case_id, e.text, log10_p AS score FROM cases c JOIN entries e ON e.keys = c.keys),
more AS (SELECT case_id, text, lexical AS score FROM whole WHERE segments > 1 AND (case_id, text) NOT IN (SELECT (case_id, text) FROM single))
SELECT case_id, text, round(score, 6) AS score, 'word' AS kind FROM single UNION ALL SELECT case_id, text, round(score, 6), 'composition' FROM more""")
def candidate_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole entries and all compositions of each case."""
    entries = _entries(spark, sf_dir)
    composed = lattice.decoded(_cases(spark, sf_dir), entries, longest=4, beam=100_000, per_span=100_000)
    return decoding.generated(_cases(spark, sf_dir), entries, composed, most=100_000).select("case_id", "text", F.round("score", 6).alias("score"), "kind")


# Near-duplicates and guards

_TURNS = f"""turns AS (SELECT conv_id * 1000 + turn AS key, conv_id, role, {sql_han('text')} AS text FROM conversations),
keyed AS (SELECT *, regexp_replace(text, '[^一-鿿]', '', 'g') AS k FROM turns),
sets AS (SELECT key, conv_id, role, k, CASE WHEN len(k) < 4 THEN [k] ELSE list_distinct(list_transform(range(1, len(k) - 2), lambda i: k[i : i + 3])) END AS s FROM keyed WHERE k <> ''),
x AS (SELECT k, len(s) AS n, unnest(s) AS g FROM (SELECT k, any_value(s) AS s FROM sets GROUP BY k)),
sim AS (SELECT a.k AS ak, b.k AS bk, count(*) / (a.n + b.n - count(*)) AS j FROM x a JOIN x b USING (g) WHERE a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.25)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, conv_id, role, text of every turn."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "conv_id", "role", han("text").alias("text"))


@query(f"""WITH {_TURNS}, least AS (SELECT k, min(key) AS key FROM sets GROUP BY k)
SELECT a.key AS a_key, b.key AS b_key, round(j, 6) AS similarity FROM sim JOIN least a ON a.k = ak JOIN least b ON b.k = bk WHERE a.key < b.key""")
def turn_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different turns with a similarity of 0.25 of their letter 4-grams; equal turns are one, by their least key."""
    rows = _turns(spark, sf_dir).groupBy(F.regexp_replace("text", "[^一-鿿]", "").alias("k")).agg(F.min("key").alias("key"))
    out = corpus.similar_within(rows.filter("k <> ''").select("key", F.col("k").alias("shingles")), 0.25)
    return out.withColumn("similarity", F.round("similarity", 6))


_SIDE = "CASE conv_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END"


@query(f"""WITH {_TURNS}, train AS (SELECT DISTINCT k FROM sets WHERE {_SIDE} = 'train'), near AS (SELECT ak AS k FROM sim WHERE bk IN (SELECT k FROM train) UNION SELECT k FROM train)
SELECT key FROM keyed WHERE {_SIDE} = 'train' OR k NOT IN (SELECT k FROM near)""")
def cross_split_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns dealt to splits by conversation, without those of dev and test that are near one of train."""
    side = F.when(F.col("conv_id") % 3 == 0, "test").when(F.col("conv_id") % 3 == 1, "dev").otherwise("train")
    return guards.without_leaks(_turns(spark, sf_dir).withColumn("split", side), "key", "text", "split", 0.25).select("key")


@query(f"""WITH {_TURNS}, refs AS (SELECT item_id, regexp_replace({sql_han('text')}, '[^一-鿿]', '', 'g') AS k FROM benchmark),
r8 AS (SELECT g, arg_min(item_id, (item_id::VARCHAR, i)) AS item_id FROM (SELECT item_id, unnest(range(1, len(k) - 6)) AS i, k[i : i + 7] AS g FROM refs) GROUP BY 1),
t8 AS (SELECT key, unnest(range(1, len(k) - 6)) AS i, k[i : i + 7] AS g FROM keyed)
SELECT key, 'shared' AS kind, arg_min(item_id, i)::VARCHAR AS reference_key FROM t8 JOIN r8 USING (g) GROUP BY 1""")
def evaluation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that share eight letters in a row with a benchmark item; none is as a whole near one."""
    refs = guards.references([("benchmark", table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), han("text").alias("text")))])
    return guards.guarded(_turns(spark, sf_dir), refs, 0.7).select("key", "kind", "reference_key")


@query(f"""WITH {_TURNS}, hit AS (SELECT a.key, a.role AS ar, b.key AS other, b.role AS br, j AS similarity FROM sim JOIN sets a ON a.k = ak JOIN sets b ON b.k = bk
  UNION ALL SELECT a.key, a.role, b.key, b.role, 1 FROM sets a JOIN sets b ON a.k = b.k AND a.key <> b.key)
SELECT key, 'internal' AS kind, other::VARCHAR AS other, round(similarity, 6)::DOUBLE AS similarity FROM hit WHERE ar = 'assistant' AND br = 'assistant' AND other < key
UNION ALL SELECT key, 'external', other::VARCHAR, round(similarity, 6)::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY similarity DESC, other::VARCHAR) AS r FROM hit WHERE ar = 'assistant' AND br <> 'assistant') WHERE r <= 3""")
def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistants' turns as items against all others, the three nearest, and against earlier items."""
    rows = _turns(spark, sf_dir)
    items = rows.filter("role = 'assistant'").withColumn("position", F.col("key"))
    out = guards.leaks(items, rows.filter("role <> 'assistant'"), 0.25)
    return out.withColumn("similarity", F.round("similarity", 6))


_STANDARD, _SIMPLE = HAN[:20], HAN[20:]


@query(f"""WITH x AS (SELECT conv_id, turn, {sql_han('text')} AS t, regexp_replace({sql_han('text')}, '[^一-鿿]', '', 'g') AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN k = '' THEN 'none' WHEN regexp_matches(k, '[{_SIMPLE[3:]}]') THEN 'simplified' WHEN regexp_matches(k, '[^{_STANDARD}]') THEN 'non_standard' ELSE 'standard' END AS script_class,
round(CASE WHEN k = '' THEN 0 ELSE len(regexp_replace(k, '[^{_STANDARD}]', '', 'g')) / len(k) END, 6)::DOUBLE AS standard_ratio FROM x""")
def script_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty letters are standard, the last three simplified."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", han("text").alias("text"))
    chars = lambda s: spark.createDataFrame([(c,) for c in s], "char string")
    out = guards.classified(rows, "text", chars(_SIMPLE[3:]), chars(_STANDARD))
    return out.select("conv_id", "turn", "script_class", F.round("standard_ratio", 6).alias("standard_ratio"))


@query(f"""WITH t AS (SELECT {sql_han('text')} AS text FROM conversations), g AS (SELECT text[i : i + n - 1] AS gram FROM (SELECT text, n, unnest(range(1, len(text) - n + 2)) AS i FROM t, (VALUES (2), (3), (4)) z(n)))
SELECT gram, count(*) AS c FROM g WHERE regexp_matches(gram, '[{HAN[:3]}]') GROUP BY 1""")
def alphabet_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two to four characters with one of the first three letters."""
    return guards.alphabet_grams(_texts(spark, sf_dir), spark.createDataFrame([(c,) for c in HAN[:3]], "char string"))
