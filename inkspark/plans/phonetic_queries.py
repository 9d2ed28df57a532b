"""Queries of phonetics on syllables that are put together from the events' numbers: right and wrong ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions import phonetics as ph
from inkspark.operators import cases, errors, lexicons
from inkspark.plans.registry import query, table
from inkspark.sources.shared import written


def _pick(symbols: str, k: str) -> str:
    """The symbol at k, none at 0; both engines read this."""
    return f"CASE WHEN {k} = 0 THEN '' ELSE substring('{symbols}', CAST({k} AS INT), 1) END"


_BODY = f"concat({_pick(ph.INITIALS, 'event_id % 22')}, {_pick(ph.MEDIALS, 'user_id % 4')}, {_pick(ph.FINALS, '(event_id + user_id) % 14')}, {_pick(ph.MARKS, 'event_id % 6')})"
_NEXT = f"concat({_pick(ph.INITIALS, 'user_id % 22')}, {_pick(ph.MEDIALS, 'event_id % 4')}, {_pick(ph.FINALS, '(event_id + 3) % 14')}, {_pick(ph.MARKS, 'user_id % 6')})"
_RAW = f"concat(CASE WHEN event_id % 17 = 0 THEN '˙' ELSE '' END, {_BODY}, CASE WHEN event_id % 13 = 0 THEN 'ㄅ' ELSE '' END)"
_PAIR = f"concat({_BODY}, CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN '-' WHEN 2 THEN '' ELSE '  ' END, {_NEXT})"


def _sql_canonical(x: str) -> str:
    part = lambda k: f"regexp_extract({x}, '{ph.SYLLABLE}', {k})"
    valid = f"regexp_matches({x}, '{ph.SYLLABLE}') AND {part(2)} || {part(3)} || {part(4)} <> '' AND NOT ({part(1)} <> '' AND {part(5)} <> '')"
    mark = f"CASE WHEN {part(1)} <> '' OR {part(5)} = '˙' THEN '˙' WHEN {part(5)} = 'ˉ' THEN '' ELSE {part(5)} END"
    return f"CASE WHEN {valid} THEN {part(2)} || {part(3)} || {part(4)} || {mark} END"


def _raw(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.expr(text).alias("raw")).distinct()


@query(f"SELECT raw, {_sql_canonical('raw')} AS syllable FROM (SELECT DISTINCT {_RAW} AS raw FROM events)")
def parse_syllable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, _RAW).select("raw", ph.canonical("raw").alias("syllable"))


_SYMBOLS = f"[{ph.INITIALS}{ph.MEDIALS}{ph.FINALS}]+[{ph.MARKS}]?"


@query(f"""SELECT raw, CASE WHEN regexp_matches(raw, '^[ \t-]*(?:{_SYMBOLS}[ \t-]*)+$') AND len(list_filter(parts, lambda p: p IS NULL)) = 0 THEN array_to_string(parts, '|') END AS reading
FROM (SELECT raw, list_transform(regexp_extract_all(raw, '{_SYMBOLS}'), lambda x: {_sql_canonical('x')}) AS parts FROM (SELECT DISTINCT {_PAIR} AS raw FROM events))""")
def parse_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = ph.reading("raw")
    return _raw(spark, sf_dir, _PAIR).select("raw", F.when(read.isNotNull(), F.array_join(read, "|")).alias("reading"))


_KEYED = f"translate({_PAIR}, '{ph.INITIALS + ph.MEDIALS + ph.FINALS}ˊˇˋ˙ˉ-', '{ph.SYMBOL_KEYS}6347  ')"


@query()
def parse_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs as keystrokes, with spaces between syllables."""
    typed = ph.typed("raw")
    return _raw(spark, sf_dir, _KEYED).select(F.col("raw").alias("keys"), F.when(typed.isNotNull(), F.array_join(typed, "|")).alias("reading"))


@query(f"""WITH s AS (SELECT user_id, event_id, {_sql_canonical('raw')} AS r FROM (SELECT user_id, event_id, {_BODY} AS raw FROM events)), inv AS (SELECT DISTINCT r FROM s WHERE event_id % 2 = 0 AND r IS NOT NULL),
n AS (SELECT user_id, row_number() OVER w - 1 AS position, r AS a, lead(r) OVER w AS b FROM s WHERE r IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
x AS (SELECT user_id, position, regexp_replace(a, '[ˊˇˋ˙]$', '') AS ba, regexp_extract(a, '[ˊˇˋ˙]?$') AS ta, regexp_replace(b, '[ˊˇˋ˙]$', '') AS bb, regexp_extract(b, '[ˊˇˋ˙]?$') AS tb FROM n WHERE b IS NOT NULL)
SELECT user_id, position::INT AS position, ba || tb AS "first", bb || ta AS second FROM x WHERE ta <> tb AND ba || tb IN (SELECT r FROM inv) AND bb || ta IN (SELECT r FROM inv)""")
def tone_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's syllables in turn are a case; syllables of even events are the inventory."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", ph.canonical(F.expr(_BODY)).alias("r")).filter("r is not null")
    by_user = rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "r"))), lambda x: x["r"]).alias("readings"))
    return cases.tone_swaps(by_user, rows.filter("event_id % 2 = 0").select(F.col("r").alias("syllable")), "user_id")


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(ph.canonical(F.expr(_BODY)).alias("syllable")).filter("syllable is not null").distinct()


@query()
def error_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _inventory(spark, sf_dir)
    return errors.alternatives(known.withColumnRenamed("syllable", "observed"), known)


@query()
def noisy_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One error of each kind in each user's first syllables."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", ph.canonical(F.expr(_BODY)).alias("r")).filter("r is not null")
    by_user = written(rows.groupBy(F.col("user_id").alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "r"))), lambda x: x["r"]).alias("readings")), "user-syllables")
    # The inventory is that of `_inventory`: every event is some user's.
    inventory = by_user.select(F.explode("readings").alias("syllable")).distinct()
    return errors.noisy(by_user, inventory).withColumn("readings", F.array_join("readings", " "))


_PLANE = "(event_id % 3) + 1"


@query(f"""WITH c AS (SELECT DISTINCT n_name[1 : 1] AS ch, r, {_PLANE} AS plane FROM (SELECT event_id, user_id, {_sql_canonical('raw')} AS r FROM (SELECT event_id, user_id, {_BODY} AS raw FROM events)) JOIN nation ON n_nationkey = event_id % 25 WHERE r IS NOT NULL),
single AS (SELECT ch, r, max(CASE plane WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.1 END) AS w FROM c GROUP BY 1, 2 HAVING w IS NOT NULL),
rated AS (SELECT DISTINCT ch, r, CASE (ascii(ch) % 5) + 1 WHEN 5 THEN 1000.0::DOUBLE WHEN 4 THEN 200 WHEN 3 THEN 50 WHEN 2 THEN 10 ELSE 3 END AS t FROM c WHERE ch < 'F')
SELECT coalesce(s.ch, rated.ch) AS text, coalesce(s.r, rated.r) AS reading, coalesce(t, w) AS frequency FROM single s FULL JOIN rated ON s.ch = rated.ch AND s.r = rated.r""")
def lexicon_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' first letters with events' syllables, by plane; letters before F are rated too."""
    read = table(spark, sf_dir, "events").select("event_id", ph.canonical(F.expr(_BODY)).alias("reading"), F.concat_ws("-", F.expr(_PLANE), F.lit("1")).alias("cns_code")).filter("reading is not null")
    chars = read.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("event_id") % 25).select(F.left("n_name", F.lit(1)).alias("char"), "reading", "cns_code").distinct()
    rated = chars.filter("char < 'F'").select(F.col("char").alias("text"), (F.ascii("char") % 5 + 1).alias("tier"), F.array("reading").alias("readings")).distinct()
    return lexicons.assembled(rated, chars)


@query("SELECT DISTINCT ch, translate(ch, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '22233344455566677778889999') AS \"group\" FROM (SELECT unnest(string_split(n_name, '')) AS ch FROM nation) WHERE regexp_matches(ch, '^[A-Z]$')")
def character_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of nations' names by their telephone keys."""
    letters = table(spark, sf_dir, "nation").select(F.explode(F.regexp_extract_all("n_name", F.lit("[A-Z]"), F.lit(0))).alias("ch")).distinct()
    keyed = letters.groupBy(F.translate("ch", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999").alias("group")).agg(F.array_join(F.sort_array(F.collect_list("ch")), " ").alias("characters"))
    return cases.character_groups(keyed)
