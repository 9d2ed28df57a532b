"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, in every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkspark.llm import decontam, edits, interpolation, line_dedup, outliers, packing, personal, secrets, simhash, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, kept boolean, words string, line_no int, text_key long, blob string, spans string, chunk long, item_id int, host string, h long, _id long, __key string, _T long"
UNBROKEN = "ab1" * 60_000
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))


def _rows(spark, empty=False):
    text = " ".join(f"w{i}" for i in range(80))
    texts = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text, None, None), (3, None, "en", None), (4, "", None, "a"), (5, " \n\t\n", "en", "a"), (6, LONG, "en", "a"), (None, "same words here", "en", "a"), (7, "same words here", "en", "a"), (8, "é 😀 \U00020000", "x", "a"), (9, "nul \0 in text", "x", "b"), (10, UNBROKEN, "en", "a")]
    return spark.createDataFrame([] if empty else [(*t, 0, 1, True, "w", 2, 3, "b", "s", 4, 5, "h", 6, 7, "k", 8) for t in texts], SCHEMA)


OPERATORS = {
    "outliers": (outliers.judged, 1), "lines": (line_dedup.deduplicated, 1), "packing": (packing.packed, None), "built": (edits.built, 1),
    "secrets": (lambda d: secrets.digests(secrets.scanned(d)[0]), 1), "personal": (lambda d: personal.digests(personal.detected(d)), 1), "sanitised": (personal.sanitised, 1),
    "simhash": (simhash.grouped, 1), "scored": (interpolation.scored, 1), "edited": (lambda d: edits.edited(edits.built(d).withColumn("edits", F.array(F.struct(F.lit(5).alias("start"), F.lit(9).alias("end"), F.lit("x").alias("new"))))), 1),
    "contained": (lambda d: decontam.contained(d, d.select(F.col("doc_id").alias("item_id"), "text")), None),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("empty", [False, True])
def test_operator(spark, name, empty):
    run, per_row = OPERATORS[name]
    docs = _rows(spark, empty)
    n = run(docs).count()
    assert n == docs.count() if per_row else (n == 0) == empty


@pytest.mark.parametrize("empty", [False, True])
def test_urls(spark, empty):
    rows = [] if empty else [(1, "HTTP://A.Example.NET/en/x?y", "h", 1), (1, "HTTP://A.Example.NET/en/x?y", "h", 1), (None, None, None, None), (2, "://", "", 2), (3, "http://" + "ab" * 400 + ".com/" + "p/" * 2000, "q", 3)]
    out = urls.judged(spark.createDataFrame(rows, "page_id long, url string, host string, n int")).collect()
    assert len(out) == len(rows) and (empty or {r.host for r in out} >= {"a.example.net", ""})


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    sf = str(tmp_path)
    spark.createDataFrame([] if empty else [(1, " ".join(f"w{i}" for i in range(20, 40))), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, seen = _rows(spark, empty), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        seen.append(sorted(r.doc_id for r in docs.collect() if r.doc_id is not None))
    # Quality: texts with fewer than 50 words go, and the one of rare words. Lines: document 2 keeps its row with no
    # text, as 1 has it all. Near copies: equal rows with the least id of their group both stay. Benchmark: 1 has an item.
    assert seen == ([[]] * 5 if empty else [[1, 1, 2]] * 3 + [[2]] * 2)


def test_values_of_defined_cases(spark):
    """What null, empty, blank, very long and repeated texts give, operator by operator."""
    docs = _rows(spark)
    by = lambda df: {r.doc_id: r for r in df.collect()}
    quality = by(outliers.judged(docs))
    assert all(quality[i].n_words == 0 and quality[i].base_failed and not quality[i].kept for i in (3, 4, 5)) and quality[6].n_words == 60_000 and quality[10].n_words == 1
    lines = by(line_dedup.deduplicated(docs))
    assert lines[3].text is None and lines[4].text == "" and lines[5].text == " \n\t\n" and lines[2].text == "" and lines[1].text == lines[1].text != "" and lines[6].text == LONG
    pieces = [r for r in packing.packed(docs).collect()]
    assert [(r.length, r.start) for r in pieces if r.doc_id in (3, 4, 5)] == [(1, 0)] * 3 and sum(r.doc_id == 6 for r in pieces) == -(-sum(r.length for r in pieces if r.doc_id == 6) // 4096)
    trees = by(edits.built(docs))
    assert [trees[i].n_tokens for i in (3, 4)] == [0, 0] and "".join(trees[6].parts) == LONG and trees[3].parts == [""]
    found = secrets.digests(secrets.scanned(docs)[0])
    assert all(r.spans == "" and r.n_assign == r.n_access == r.n_hex == 0 for r in found.filter("doc_id in (3, 4, 5, 6)").collect())
    said = by(personal.digests(personal.detected(docs)))
    assert all(said[i].spans == "" for i in (3, 4, 5, 6))
    prints = by(simhash.grouped(docs))
    assert [prints[i].fp for i in (3, 4, 5)] == [0, 0, 0] and {prints[i].component_id for i in (3, 4, 5)} == {3} and prints[2].component_id == 1 and prints[7].component_id == 7
    scores = by(interpolation.scored(docs))
    assert all(scores[i].n_tokens == 1 for i in (3, 4, 5)) and scores[6].n_tokens == 60_001
    shared = {(r.doc_id, r.item_id) for r in decontam.contained(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).collect()}
    assert shared == {(1, 1), (1, 2), (2, 1), (2, 2), (6, 6)}


def test_null_urls_have_no_evidence(spark):
    out = {r.page_id: r for r in urls.judged(spark.createDataFrame([(1, None), (2, "no address"), (3, "a://"), (4, "x://H.Org/fr/"), (4, "x://H.Org/fr/")], "page_id long, url string")).collect()}
    assert all((out[i].host, out[i].path, out[i].rule, out[i].verdict) == ("", "", None, "allow") for i in (1, 2, 3)) and (out[4].host, out[4].rule) == ("h.org", "org/fr/")


def test_pipeline_drops_what_is_planted(spark):
    """Leaks and copies go, documents of good quality stay, and the rest is packed whole."""
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    judged = {r.doc_id for r in outliers.judged(docs).filter("kept").collect()}
    after = line_dedup.deduplicated(docs.join(spark.createDataFrame([(i,) for i in judged], "doc_id long"), "doc_id", "left_semi"))
    groups = {r.doc_id: r.component_id for r in simhash.grouped(after).collect()}
    single = {i for i, c in groups.items() if i == c}
    leaks = {r.doc_id for r in decontam.contained(after, items).collect()}
    assert leaks & single and kept == single - leaks
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    assert len(good & judged) == len(good & {r.doc_id for r in outliers.judged(docs).filter("not base_failed").collect()})
