"""Operators on small tables with known results."""

import math
import random
import re

from pyspark.sql import functions as F

from inkspark.functions import text as tx
from inkspark.operators import corpus, lattice, lexicons, metrics, models, ngrams, ranking
from inkspark.plans import catalog
from inkspark.sources import readers


def test_tokens(spark):
    df = spark.createDataFrame([("共3,400元 ABC股$與^",), ("",)], "text string")
    assert [r.t for r in df.select(tx.tokens("text").alias("t")).collect()] == [["共", "0", "元", "A", "股", "與"], []]


def test_sentences(spark):
    df = spark.createDataFrame([("一、本府依法辦理登記。好。請於期限內完成申報！",)], "text string")
    assert df.select(tx.sentences("text")).first()[0] == ["本府依法辦理登記。", "請於期限內完成申報！"]


def test_long_sentence_is_packed_at_commas(spark):
    part = "這是一個相當長的子句內容" * 4 + "，"
    out = spark.createDataFrame([(part * 5,)], "text string").select(tx.sentences("text")).first()[0]
    assert "".join(out) == part * 5 and max(map(len, out)) <= 120 and len(out) == 3


def test_marks_after_script_only(spark):
    df = spark.createDataFrame([("好,A,3:00 是(吧)?",)], "text string")
    assert df.select(tx.wide_marks("text")).first()[0] == "好，A,3:00 是（吧）?"


def test_grams_with_surrogates(spark):
    df = spark.createDataFrame([("a𠀀b😀c",), ("a",), ("",)], "text string")
    assert [r[0] for r in df.select(tx.grams("text", 2)).collect()] == [["a𠀀", "𠀀b", "b😀", "😀c"], [], []]


def _corpus(spark):
    return spark.createDataFrame([("今天天氣很好",), ("今天很好",), ("天氣不好",), ("好天氣",)], "text string")


def test_probabilities_sum_to_one(spark):
    """Over the vocabulary, the chances after any seen history sum to one in either model."""
    counts = ngrams.counted(_corpus(spark)).cache()
    vocab = [r.gram for r in counts.filter("n = 1").collect()]
    rows = [(k, i, t, h[-1] + t, h + t) for k, h in enumerate(("^^", "今天", "天氣", "不好")) for i, t in enumerate(vocab)]
    pos = spark.createDataFrame(rows, "k int, i int, g1 string, g2 string, g3 string")
    for model in (models.witten_bell(pos, counts, least=1), models.kneser_ney(pos, counts)):
        for r in model.groupBy("k").agg(F.sum("p").alias("s")).collect():
            assert math.isclose(r.s, 1.0, abs_tol=1e-9)


def test_bucket_prior(spark):
    df = spark.createDataFrame([(f"w{i}", i + 1) for i in range(10)], "word string, v int")
    got = {r.word: r.weight for r in lexicons.bucket_prior(df, "v", "word").collect()}
    assert [got[f"w{i}"] for i in reversed(range(10))] == [50, 20, 20, 10, 10, 10, 10, 3, 3, 3]


def test_first_and_reasons(spark):
    rows = spark.createDataFrame([(1, "a", "k1"), (2, "a", "k1"), (3, "b", "k1"), (4, "b", "k2")], "id int, src string, key string")
    assert sorted(r.id for r in corpus.first_of(rows, "key", ("id",)).collect()) == [1, 4]
    assert {r.id: r.reason for r in corpus.duplicate_reasons(rows, "key", "src", ("id",)).collect()} == {1: "kept", 2: "duplicate_in_source", 3: "duplicate_other_source", 4: "kept"}


def test_similar_finds_what_brute_force_finds(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdef") for _ in range(rng.randint(3, 40))) for _ in range(15)]
    texts = [b if rng.random() < 0.3 else b[: rng.randint(2, len(b))] + rng.choice("xyz") for b in base for _ in range(4)]
    sets = corpus.shingle_table(spark.createDataFrame(list(enumerate(texts)), "key int, text string"), "key", "text", 3, "latin")
    got = {(r.a_key, r.b_key) for r in corpus.similar(sets, sets, 0.6).collect()}
    s = [{t[i : i + 3] for i in range(max(1, len(t) - 2))} for t in texts]
    assert got == {(i, j) for i in range(len(s)) for j in range(len(s)) if len(s[i] & s[j]) >= 0.6 * len(s[i] | s[j]) - 1e-12}
    bands = corpus.banded(sets)
    near = {(r.x, r.y) for r in bands.select(F.col("key").alias("x"), "band", "bucket").join(bands.select(F.col("key").alias("y"), "band", "bucket"), ["band", "bucket"]).select("x", "y").distinct().collect()}
    assert len(got & near) >= 0.8 * len(got)


def test_document_pairs_against_brute_force(spark):
    """All documents: a member row each, and every pair of representatives at 0.7."""
    sf, key = "/root/testdata/sf0.001", lambda t: re.sub("[^A-Za-zÀ-ÿ]", "", t or "")
    docs = {r.doc_id: key(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    least = {}
    for i in sorted(docs):
        least.setdefault(docs[i] or i, i)
    sets = {i: {k[j : j + 4] for j in range(max(1, len(k) - 3))} for k, i in least.items() if isinstance(k, str)}
    want = {(i, j, round(m / (len(x) + len(y) - m), 6)) for i, x in sets.items() for j, y in sets.items() if i < j and (m := len(x & y)) >= 0.7 * (len(x) + len(y) - m)}
    out = catalog.queries()["document_jaccard_pairs"](spark, sf).collect()
    assert {r.b_key: r.a_key for r in out if r.kind == "member"} == {i: least[k or i] for i, k in docs.items()}
    got = [(r.a_key, r.b_key, r.similarity) for r in out if r.kind == "pair"]
    assert set(got) == want and len(got) == len(want) > 0 and len(out) == len(docs) + len(want)


def test_long_cases_are_decoded_and_reached(spark):
    cases = spark.createDataFrame([(1, ["a", "b"] * 20), (2, ["a"] * 34 + ["x"]), (3, ["b", "a"])], "case_id int, readings array<string>")
    entries = spark.createDataFrame([("a", 1, "A", -1.0), ("b", 1, "B", -1.0), ("a b", 1, "C", -1.5)], "reading string, rank int, text string, log10_p double")
    best = {r.case_id: (r.text, r.score, r.segments) for r in lattice.decoded(cases, entries, 2).filter("rank = 1").collect()}
    assert best == {1: ("C" * 20, -30.0, 20), 3: ("BA", -2.0, 2)}
    assert {r.case_id: r.reachable for r in lattice.reachable(cases, entries, 2).collect()} == {1: True, 2: False, 3: True}


def test_concentration_keeps_words_with_ties(spark, tmp_path):
    rows = [(1, "en", "s", "tie only low"), (2, "de", "s", "tie low deu"), (3, "fr", "s", "low high high2"), (4, "fr", "s", "high low2 low3")]
    spark.createDataFrame(rows, "doc_id int, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: (r.lang, r.share) for r in catalog.queries()["domain_concentration"](spark, str(tmp_path)).collect()}
    assert got["tie"] == ("de", 0.5) and got["low"] == ("fr", 0.428571) and got["only"] == ("en", 1.0) and got["high"] == ("fr", 1.0)
    assert set(got) == {w for r in rows for w in re.findall("[a-zà-ÿ]+", r[3])}


def test_exact_paired_test(spark):
    for gained, lost, p in ((8, 15, 0.21), (15, 18, 0.728), (0, 0, 1.0)):
        rows = [(False, True)] * gained + [(True, False)] * lost + [(True, True)]
        got = metrics.paired(spark.createDataFrame(rows, "b boolean, a boolean"), "b", "a").first()
        assert (got.gained, got.lost) == (gained, lost) and abs(got.p - p) < 5e-4


def test_zero_weight_keeps_the_base_order(spark):
    rng = random.Random(3)
    rows = [(c, i, float(rng.randint(-3, 0)), rng.random()) for c in range(20) for i in range(6)]
    df = spark.createDataFrame(rows, "c int, i int, s double, p double")
    base = {(r.c, r.i): r["rank"] for r in ranking.ordered(df, "c", "s", "i").collect()}
    assert base == {(r.c, r.i): r["rank"] for r in ranking.mixed(df, "c", "s", "p", 0.0, "i").collect()}


def test_fallback_reasons(spark):
    rows = [("ok", 0.4), ("ok", 0.6), ("sum", 0.4), ("range", 1.2), ("range", -0.2), ("null", None)]
    got = {r.c: r.reason for r in ranking.judged_contextual(spark.createDataFrame(rows, "c string, p double"), "c", "p").collect()}
    assert got == {"ok": None, "sum": "sum", "range": "out_of_range", "null": "missing"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('# head\n{"id": "1", "t": "x y"}\n\n{"id": "2", "t": "z"}\n')
    assert [r.t for r in readers.commented_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, t string").collect()] == ["x y", "z"]
    (tmp_path / "b.txt").write_bytes("中文".encode("cp950"))
    assert readers.decoded(spark, str(tmp_path / "b.txt")).first().text == "中文"
    (tmp_path / "c.tsv").write_text("q\ta\n你好\tAns: 可以\n再見\t\n")
    rows = readers.unpivoted(readers.delimited(spark, str(tmp_path / "c.tsv")), "s", "q", ("q", "a"), prefix="Ans:")
    assert sorted((r.field, r.text) for r in rows.collect()) == [("a", " 可以"), ("q", "你好"), ("q", "再見")]


def test_bradley_terry_against_its_rule(spark):
    """Strengths by the plain minorise-maximise steps, option by option."""
    rng = random.Random(5)
    options = ["a", "b", "c", "d"]
    f = {(x, y): 0.0 for x in options for y in options if x != y}
    for i, x in enumerate(options):
        for y in options[i + 1 :]:
            f[x, y] = rng.random()
            f[y, x] = 1 - f[x, y]
    s = {x: 0.25 for x in options}
    for _ in range(200):
        new = {x: sum(f[x, y] + 0.1 for y in options if y != x) / sum(1.2 / (s[x] + s[y]) for y in options if y != x) for x in options}
        s = {x: v / sum(new.values()) for x, v in new.items()}
    rows = spark.createDataFrame([(1, x, y, v) for (x, y), v in f.items()], "c int, a string, b string, f double")
    got = {r.option: r.p for r in ranking.bradley_terry(rows, "c").collect()}
    assert all(math.isclose(got[x], s[x], rel_tol=1e-6) for x in options)


def test_confidence_with_signals(spark):
    rows = [("a", 0.7, 0.1, None), ("a", 0.2, 0.1, None), ("a", 0.1, 0.1, None), ("b", 0.5, 0.6, 0.0), ("b", 0.5, 0.6, 0.0), ("c", 1.0, None, None), ("d", 0.8, 0.25, 0.1), ("d", 0.2, 0.25, 0.1)]
    df = spark.createDataFrame(rows, "k string, p double, dis double, ins double")
    got = {r.k: r for r in ranking.confidence(df, "k", "p", disagreement="dis", instability="ins").collect()}
    ramp = lambda x, a, b: min(1, max(0, (x - a) / (b - a)))
    for k in "abd":
        ps = sorted((p for c, p, *_ in rows if c == k), reverse=True)
        dis, ins = next((d, i) for c, _, d, i in rows if c == k)
        h = -sum(p * math.log(p) for p in ps) / math.log(len(ps))
        gate = ramp(ps[0] - ps[1], 0.05, 0.3) * (1 - ramp(h, 0.7, 0.95)) * (1 - ramp(dis or 0, 0, 0.5)) * (1 - ramp(ins or 0, 0, 0.5))
        assert math.isclose(got[k].margin, ps[0] - ps[1], abs_tol=1e-12) and math.isclose(got[k].gate, gate, abs_tol=1e-12) and math.isclose(got[k].weight, 0.6 * gate, abs_tol=1e-12)
    assert (got["c"].gate, got["c"].confident) == (0.0, False)


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)] + [("b", v) for v in (7, 7, 9)] + [("c", None)], "k string, v int")
    got = {r.k: (r.p25, r.p50) for r in metrics.nearest(df, "v", (0.25, 0.5), ("k",)).collect()}
    assert got == {"a": (2, 3), "b": (7, 7)}


def test_contextual_answers(spark):
    asked = spark.createDataFrame([(c, o) for c in ("ok", "late", "none", "odd", "few", "sum", "nan") for o in ("x", "y")] + [("one", "x")], "c string, option string")
    rows = [("ok", "x", 0.3, None), ("ok", "y", 0.7, None), ("late", None, None, "timeout"), ("odd", "x", 0.5, None), ("odd", "y", 0.5, None), ("odd", "z", 0.0, None), ("few", "x", 1.0, None), ("sum", "x", 0.5, None), ("sum", "y", 0.6, None), ("nan", "x", float("nan"), None), ("nan", "y", 0.5, None)]
    answered = spark.createDataFrame(rows, "c string, option string, p double, error string")
    got = {r.c: r.reason for r in ranking.answers_judged(asked, answered, "c").collect()}
    assert got == {"ok": None, "one": None, "late": "timeout", "none": "empty_response", "odd": "unknown_candidate", "few": "invalid_probability", "sum": "invalid_probability", "nan": "invalid_probability"}


def test_hybrid_and_contract(spark):
    rows = [("a", 0, "x", -1.0, 0.1, "ok"), ("a", 1, "y", -1.2, 0.9, "ok"), ("b", 0, "x", -1.0, 0.1, "fallback"), ("b", 1, "y", -0.5, 0.9, "fallback")]
    df = spark.createDataFrame(rows, "c string, i int, t string, s double, p double, st string")
    got = {(r.c, r.t): r["rank"] for r in ranking.hybrid(df, "c", "s", "p", "st", 0.6, "i").collect()}
    assert got == {("a", "y"): 1, ("a", "x"): 2, ("b", "x"): 1, ("b", "y"): 2}
    assert ranking.contract_breaches(df, "c", "t", "i").count() == 0
    bad = spark.createDataFrame([("p", 1, "x"), ("t", 0, "x"), ("t", 1, "x")], "c string, i int, t string")
    assert {r.c: r.breach for r in ranking.contract_breaches(bad, "c", "t", "i").collect()} == {"p": "positions", "t": "repeated_text"}
    judged = spark.createDataFrame([("a", "x", "y", 0.8), ("a", "y", "x", 0.4)], "c string, option string, other string, f double")
    assert ranking.disagreement(judged, "c", "option", "f").first().disagreement == 0.2


def test_causes_of_misses(spark):
    from inkspark.operators import scores

    word = "array<struct<start:int,end:int,text:string,proper_noun:boolean,colloquial:boolean>>"
    w = lambda *x: [x]
    rows = [
        ("fam", "ab", "ab", ["1", "2"], w(0, 2, "ab", False, False), "top5", 1, False, True), ("oth", "ab", "x", ["1", "2"], w(0, 2, "ab", False, False), "unreachable", None, False, False),
        ("var", "a", "x", ["ㄚ˙"], w(0, 1, "a", False, False), "unreachable", None, False, False), ("cha", "z", "x", ["1"], w(0, 1, "z", False, False), "unreachable", None, False, False),
        ("ort", "ab", "ax", ["1", "2"], w(0, 2, "ab", False, False), "generated_ranked_low", 7, True, False), ("pro", "ab", "ax", ["1", "2"], w(0, 2, "ab", True, False), "generated_ranked_low", 7, True, True),
        ("col", "ab", "ax", ["1", "2"], w(0, 2, "ab", False, True), "outside_output", None, True, True), ("lex", "ac", "ax", ["1", "3"], w(0, 2, "ac", False, False), "outside_output", None, True, True),
        ("seg", "ab", "ax", ["1", "2"], w(0, 2, "ab", False, False), "outside_output", None, True, True), ("bea", "a", "x", ["1"], w(0, 1, "a", False, False), "beam_pruned", None, True, True), ("sco", "a", "x", ["1"], w(0, 1, "a", False, False), "generated_ranked_low", 6, True, True),
    ]
    df = spark.createDataFrame(rows, f"item_id string, gold string, top1 string, readings array<string>, words {word}, stage string, rank int, window_hit boolean, exact_surface boolean")
    lexicon = spark.createDataFrame([("a", "1"), ("b", "2"), ("ab", "1 2"), ("a", "ㄚ")], "text string, reading string")
    missed = scores.causes(df, lexicon)
    got = {r.item_id: (r.category, r.position) for r in missed.collect()}
    assert got == {
        "fam": ("candidate_family_issue", None), "oth": ("other", None), "var": ("pronunciation_variant_missing", 0), "cha": ("character_reading_missing", 0), "ort": ("orthographic_variant", 1), "pro": ("proper_noun", 1),
        "col": ("colloquial_word", 1), "lex": ("lexical_missing", 1), "seg": ("segmentation_missing", 1), "bea": ("beam_pruned", 0), "sco": ("score_pruned", 0),
    }
    counts, examples = scores.taxonomy(missed)
    assert counts.filter("category is null and stage is null").first().n == 11 and examples.count() == 11
    cover = scores.lexical_coverage(df.filter("item_id in ('lex', 'cha')").withColumnRenamed("gold", "text"), lexicon).first()
    assert math.isclose(cover.oov_rate, 2 / 3) and math.isclose(cover.reading_coverage, 2 / 3) and cover.word_coverage == 0.0


def test_equal_outputs_and_stale_cases(spark):
    from inkspark.operators import scores

    a = spark.createDataFrame([("x", 0, "t", 0.1), ("y", 0, "t", 0.2)], "case_id string, rank int, text string, score double")
    b = spark.createDataFrame([("x", 0, "t", 0.1 + 1e-12), ("y", 0, "u", 0.2)], "case_id string, rank int, text string, score double")
    assert [r.case_id for r in scores.same_outputs(a, b).collect()] == ["y"] and {r.case_id for r in scores.same_outputs(a, b, None).collect()} == {"x", "y"}
    s, t = ({r.case_id: r.signature for r in scores.signatures(df).collect()} for df in (a, b))
    assert s["x"] == t["x"] and s["y"] != t["y"]
    cases = spark.createDataFrame([("x", ["t"]), ("y", ["u"]), ("z", [])], "case_id string, candidates array<string>")
    assert [r.case_id for r in scores.stale(cases, a).collect()] == ["y"]


def test_guard_prefers_near_duplicates_and_first_references(spark):
    from inkspark.operators import guards

    refs = guards.references([("one", spark.createDataFrame([(1, "甲乙丙丁戊己庚辛壬"), (2, "子丑寅卯辰巳午未申")], "key int, text string")), ("two", spark.createDataFrame([(9, "甲乙丙丁戊己庚辛天地人")], "key int, text string"))])
    rows = spark.createDataFrame([("same", "甲乙、丙丁戊己庚辛壬"), ("part", "前文甲乙丙丁戊己庚辛後文很長很長很長"), ("free", "全然不同的句子在這裡"), ("empty", ""), ("none", None)], "key string, text string")
    got = {r.key: (r.kind, r.reference, r.reference_key) for r in guards.guarded(rows, refs).collect()}
    assert got == {"same": ("near_duplicate", "one", "1"), "part": ("shared", "one", "1")}


def test_indexed_matches_are_verified(spark):
    from inkspark.operators import guards

    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef") for _ in range(30)) for _ in range(12)]
    texts = base + [b[:27] + "xyz" for b in base]
    sets = corpus.shingle_table(spark.createDataFrame(list(enumerate(texts)), "key int, text string"), "key", "text", 4, "latin")
    exact = {(r.a_key, r.b_key) for r in corpus.similar(sets, sets, 0.7).collect()}
    got = {(r.key, r.reference) for r in guards.indexed_matches(sets, sets, 0.7).collect()}
    assert got <= exact and len(got) >= 0.9 * len(exact) > 12
