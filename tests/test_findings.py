"""What reviews found: each of these failed before."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.functions import text as tx
from inkspark.operators import annotation, corpus, derived, errors, guards, joins, ranking, sets
from inkspark.plans import catalog, derived_queries
from inkspark.sources import shared
from tests.compare import TABLES, connect, difference

SF = "/root/testdata/sf0.001"


def _made(spark, tmp_path, name, df):
    """A folder with `df` as one table and the driver's smallest ones as the others."""
    for t in TABLES:
        if t != name:
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_long_sentences_stay_whole(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Short one. " + "many words, " * 2000 + "end.", "en", "web", 0), (2, "Alone, here.", "de", "book", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    at = _made(spark, tmp_path, "documents", docs)
    con = connect(at)
    for name in ("sentence_split", "sentence_usable", "dedupe_first", "dedupe_reasons", "sentence_inspection", "corpus_style"):
        assert difference(catalog.queries()[name](spark, at), con, catalog.oracle_sql()[name]) == ""


def test_references_without_a_semicolon_stay(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>a &amp<style>p{}</style> &lt b &copy=1 &amp;lt; &#39;&nbsp;&hellip;</p>")], "page_id long, url string, html string")
    at = _made(spark, tmp_path, "pages", pages)
    assert difference(catalog.queries()["strip_markup_pages"](spark, at), connect(at), catalog.oracle_sql()["strip_markup_pages"]) == ""
    assert spark.range(1).select(tx.strip_markup(F.lit("&ampp &eacute;"))).first()[0] == "&p é"


@pytest.mark.parametrize("threshold", [0.25, 0.7])
def test_joined_texts_are_all_pairs(spark, monkeypatch, threshold):
    """Chunks of few n-grams, so that there are many tiles; seldom and common n-grams; characters of two planes."""
    monkeypatch.setattr(joins, "CHUNK", 300)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde\U00020000耀") for _ in range(rng.randint(1, 60))) for _ in range(25)]
    texts = sorted({b if rng.random() < 0.3 else b[: rng.randint(1, len(b))] + rng.choice("xyz") for b in base for _ in range(4)})
    sets = [{t[i : i + 4] for i in range(max(1, len(t) - 3))} for t in texts]
    j = lambda x, y: len(x & y) / len(x | y)
    df = spark.createDataFrame(list(enumerate(texts)), "key int, shingles string")
    want = {(a, b): round(s, 9) for a, x in enumerate(sets) for b, y in enumerate(sets) if (s := j(x, y)) >= threshold}
    within = joins.similar(df, None, threshold)
    assert "SortMergeJoin" not in within._jdf.queryExecution().executedPlan().toString()
    got = [((r.a_key, r.b_key), round(r.similarity, 9)) for r in within.collect()]
    assert len(got) == len(dict(got)) and dict(got) == {k: v for k, v in want.items() if k[0] < k[1]}
    half = df.filter("key % 3 = 0")
    assert {(r.a_key, r.b_key): round(r.similarity, 9) for r in joins.similar(half, df, threshold).collect()} == {k: v for k, v in want.items() if k[0] % 3 == 0}


def test_common_ngrams_are_counted_both_ways(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.zipf(1.3, rng.integers(1, 60)).astype(np.uint64)) for _ in range(150)]
    brute = lambda t: {(i, j) for j in range(150) for i in range(150) if len(np.intersect1d(rows[i], rows[j])) >= t * len(np.union1d(rows[i], rows[j])) - 1e-12}
    for dense in (1 << 25, 150 * 3):
        monkeypatch.setattr(joins, "DENSE", dense)
        for t in (0.05, 0.3, 0.8):
            got = [(int(i), int(j)) for x, y, _ in joins._met(rows, rows, t, False) for i, j in zip(x, y)]
            assert len(got) == len(set(got)) and set(got) == brute(t)
            once = {(int(i), int(j)) for x, y, _ in joins._met(rows, rows, t, True) for i, j in zip(x, y)}
            assert once == {p for p in brute(t) if p[0] < p[1]}


def test_chances_are_computed_once(spark):
    """Sums of chances differ in their last digit from one run to the next; here each evaluation differs."""
    noisy = F.udf(lambda p: p * (1 + int.from_bytes(os.urandom(4)) * 1e-22), "double").asNondeterministic()
    rows = spark.createDataFrame([(i, p) for i in range(200) for p in (0.9, 0.1)] + [(200, 0.5), (200, None), (201, None)], "case int, q double")
    got = {r["case"]: r for r in ranking.confidence(rows.withColumn("p", noisy(F.coalesce("q", F.lit(0.25)))).withColumn("p", F.when(F.col("q").isNotNull(), F.col("p"))), "case", "p").collect()}
    assert all(abs(got[i].margin - 0.8) < 1e-9 and abs(got[i].entropy - 0.468995594) < 1e-9 for i in range(200))
    assert (got[200].margin, got[200].gate, got[201].gate) == (0, 0, 0)


def _turn(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_a_clause_that_comes_often_takes_one_place(spark, tmp_path):
    words = ["".join(w) for w in zip("bcdfghjklmnpqrstvwxzbcdfghjkl", "cdfghjklmnpqrstvwxzbcdfghjklm", "fghjklmnpqrstvwxzbcdfghjklmnp", "zzxxvvttssrrqqppnnmmllkkjjhhg")]
    key = lambda w: hashlib.sha256(f"s0\0{0}\0{w.translate(str.maketrans(derived_queries.LETTERS, derived_queries.HAN))}".encode()).hexdigest()
    first = min(words, key=key)
    many = spark.range(100_001).select(F.lit(0).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat("id", F.lit(f" {first}")).alias("text"))
    at = _made(spark, tmp_path, "conversations", many.union(_turn(spark, [(0, -1, "user", "1, " + " ".join(words)), (4, 0, "system", "efgh, bcdf")])))
    got = catalog.queries()["silver_items"](spark, at)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert difference(got, connect(at), catalog.oracle_sql()["silver_items"]) == ""


def test_clauses_have_what_stands_before_them(spark):
    rows = spark.createDataFrame([("s", 1, "一丁丂，\U0001f600七丄丅丆。一丁x"), ("s", 2, "一丁丂"), ("s", 3, ""), ("s", 4, None)], "source_id string, doc_id int, text string")
    got = {(r.doc_id, r.left_context, r.clause) for r in sets.clauses(rows, 3, 4).collect()}
    assert got == {(1, "", "一丁丂"), (1, "一丁丂，\U0001f600", "七丄丅丆"), (2, "", "一丁丂")}


def test_noise_does_not_carry_a_case_with_each_place(spark):
    cases = spark.createDataFrame([(1, ["ㄅㄚ", "ㄆㄚˊ"]), (None, ["ㄆㄚˊ"]), (3, [])], "case_id int, readings array<string>")
    known = spark.createDataFrame([("ㄅㄚ",), ("ㄆㄚ",), ("ㄆㄚˊ",), ("ㄅㄚˊ",)], "syllable string")
    got = errors.noisy(cases, known)
    rows = got.collect()
    assert {r.case_id for r in rows} == {1, None} and all(r.readings[r.position] == r.reading and len(r.readings) == (2 if r.case_id else 1) for r in rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "min_by" in x and "readings" in x]


def test_script_classes_are_found_where_a_text_stands(spark):
    rows = spark.createDataFrame([(1, "一丁\U00020001 a"), (2, "一一\U00020000"), (3, "x"), (4, "一七七七"), (5, None), (6, "一!")], "id int, t string")
    chars = lambda s: spark.createDataFrame([(c,) for c in s], "char string")
    out = guards.classified(rows, "t", chars(["七", "七"]), chars(["一", "丁", "\U00020000", "一", None]), ["!"])
    assert {r.id: (r.script_class, round(r.standard_ratio, 6)) for r in out.collect()} == {1: ("non_standard", 0.666667), 2: ("standard", 1), 3: ("none", 0), 4: ("simplified", 0.25), 5: ("standard", 0), 6: ("simplified", 1)}
    assert "Join [__k" not in out._jdf.queryExecution().executedPlan().toString()
    assert guards.classified(rows, "t", chars(""), chars("")).filter("script_class = 'non_standard'").count() == 4


def test_reading_issues_take_one_pass(spark):
    rows = [(1, "一丁", ["a", "b"], ["一丁"]), (2, "一丁", ["a", None], ["一", "一丁"]), (3, "x一", ["a", "a"], []), (4, "一", ["a", "b"], ["一丁"]), (5, None, ["a"], ["一"]), (6, "\U00020000", None, None)]
    items = spark.createDataFrame(rows, "item_id int, text string, readings array<string>, acceptable array<string>")
    out = annotation.reading_issues(items.repartition(3), spark.createDataFrame([("一", "a"), ("一", "a"), ("丁", "b"), ("丁", "c")], "char string, reading string"))
    assert sorted(tuple(r) for r in out.collect()) == [(2, "alternative", -1), (2, "reading", 1), (3, "outside_script", -1), (3, "reading", 0), (4, "length", -1)]
    assert out.columns == ["item_id", "issue", "position"] and dict(out.dtypes)["position"] == "int"
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Repartition 3") == 1


def test_occurrences_are_dealt_out_once(spark, tmp_path):
    rows = [("u", "s1", 1, "一丁丂七1一丁"), ("v", "s1", 1, "一丁\n一丁"), ("v", "s2", 1, "3一丁"), ("x", "s9", 9, "一丁"), ("u", "s2", 2, "\U00020000一丁"), ("u", "s2", 3, "丁"), ("u", None, None, None)]
    s = spark.createDataFrame(rows, "slice string, source string, doc int, text string")
    wanted = spark.createDataFrame([("一丁",), ("一丁丂七",), ("\U00020000一丁",), ("丁\n一",)], "gram string")
    found = lambda whole: {r.gram: tuple(r)[1:] for r in derived.occurrences(s, wanted, "u", ("u", "v"), whole).collect()}
    assert found(True) == {"一丁": (6, 3, 2, 2, ["s1", "s2"], {"u": 3, "v": 3}), "一丁丂七": (1, 1, 1, 1, ["s1"], {"u": 1}), "\U00020000一丁": (1, 1, 1, 0, ["s2"], {"u": 1}), "丁\n一": (1, 1, 0, 1, ["s1"], {"v": 1})}
    assert {k: v[0] for k, v in found(False).items()} == {"一丁": 6, "一丁丂七": 1, "\U00020000一丁": 1}
    made = len(shared._tables[spark.sparkContext.applicationId])
    derived.occurrences(s, wanted, "u", ("u", "v"))
    last = shared._tables[spark.sparkContext.applicationId][made:]
    assert [spark.read.parquet(p).count() for p in last] == [4]


@pytest.mark.parametrize("length", [1, 2, 5, 8])
def test_shared_runs_are_found_by_blocks(spark, length):
    rng = random.Random(length)
    made = lambda n, most: ["".join(rng.choice("ab\U00020000一") for _ in range(rng.randint(0, most))) for _ in range(n)]
    texts, refs = made(150, 40), made(4, 3 * length)
    runs = {r[i : i + length].replace("a", "") for r in [x.replace("a", "").replace("b", "") for x in refs] for i in range(len(r) - length + 1)}
    want = {i for i, t in enumerate(texts) for k in [t.replace("a", "").replace("b", "")] if any(k[j : j + length] in runs for j in range(len(k) - length + 1))}
    got = corpus.overlapping(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), spark.createDataFrame([(r,) for r in refs], "t string"), "id", "t", length, "han")
    assert {r.key for r in got.collect()} == want
    assert "array_distinct" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_contexts_are_not_made_where_not_asked_for(spark):
    rows = spark.createDataFrame([("s", 1, "一丁丂")], "source_id string, doc_id int, text string")
    assert "aggregate(" not in sets.clauses(rows, 3, 4).select("clause")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("policy", list(annotation.POLICIES))
def test_only_texts_with_a_refused_character_go(spark, policy):
    chars = spark.createDataFrame([("一", ["a"], None), ("丁", ["b", "c"], "c"), ("七", ["d", "e"], None), ("丄", ["f", "g"], "h"), ("\U00020000", ["i"], None)], "char string, options array<string>, single string")
    words = spark.createDataFrame([("七\U00020001", ["d", "j"])], "word string, readings array<string>")
    rng = random.Random(7)
    texts = {"".join(rng.choice("一丁七丄x\U00020000\U00020001") for _ in range(rng.randint(0, 5))) for _ in range(400)} | {"七\U00020001", "七", None}
    known = {"unambiguous": "一\U00020000", "known_word": "一\U00020000七\U00020001", "bounded": "一丁\U00020000七\U00020001"}[policy]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    left = annotation.readable(df, chars, words, policy)
    assert {r.text for r in left.collect()} == {t for t in texts if t is not None and set(t) <= set(known)}
    got = lambda d: {r.text: r.readings for r in annotation.annotated(d, chars, words, 2, policy, checked=False).filter("readings is not null").collect()}
    whole = got(df)
    assert got(left) == whole and len(whole) > 5 and ("七\U00020001" in whole) == (policy != "unambiguous") and "七" not in whole
    assert not [x for x in annotation.annotated(df, chars, words, 2, policy)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "(i#" in x]


def test_refused_clauses_go_where_their_turn_is_read(spark, tmp_path):
    turns = [(1, 0, "user", "bcdf bcdf ghjk lmnp qrst bade 1 \U00020000vwxz, efgh É wxyz"), (1, 1, "assistant", "bcdf lmnp"), (5, 0, "user", "ghjk efef, bado"), (2, 0, "system", "ghjk aeio"), (3, 0, None, "klmn"), (4, 1, "user", None), (4, 2, "user", ""), (7, 0, "user", "bcdfghjklmnpq bcd")]
    at = _made(spark, tmp_path, "conversations", _turn(spark, turns))
    for name in ("formal_items", "silver_items"):
        made = len(shared._tables.get(spark.sparkContext.applicationId, []))
        got = catalog.queries()[name](spark, at)
        last = [spark.read.parquet(p) for p in shared._tables[spark.sparkContext.applicationId][made:]]
        kept = [d for d in last if "domain" in d.columns]
        back = str.maketrans(derived_queries.HAN, derived_queries.LETTERS)
        assert [sorted((r.doc_id, r.domain or "", r.text.translate(back)) for r in d.collect()) for d in kept] == [[(1, "assistant", "bcdf"), (1, "assistant", "lmnp"), *((1, "user", w) for w in ("bcdf", "efgh", "ghjk", "lmnp", "qrst", "vwxz", "wxyz")), (2, "system", "ghjk"), (3, "", "klmn"), (5, "user", "efef"), (5, "user", "ghjk")]]
        assert "conversations.parquet" not in got._jdf.queryExecution().toString()
        assert difference(got, connect(at), catalog.oracle_sql()[name]) == ""
