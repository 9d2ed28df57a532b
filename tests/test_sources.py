"""Readers, gates and sinks on small files."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import zipfile

import pytest

from inkspark.sources import gates, readers, writers

GOV = "id string, dataset_name string, official_dataset_url string, license string, license_url string, commercial_use string, modification string, redistribution string, ai_training string, ai_training_basis string, attribution string, downloaded_at string, sha256 string, allowed_uses array<string>, status string, kind string"
FINE = {"id": "a", "dataset_name": "d", "official_dataset_url": "u", "license": "l", "license_url": "u", "commercial_use": "allowed", "modification": "allowed", "redistribution": "allowed_with_attribution", "ai_training": "allowed", "ai_training_basis": "", "attribution": "x", "downloaded_at": "t", "sha256": "0" * 64, "allowed_uses": ["corpus"], "status": "approved", "kind": "tabular"}


def _write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.mark.parametrize(("change", "found"), [
    ({}, []), ({"status": "pending"}, ["status=pending"]), ({"ai_training": "not_allowed"}, ["ai_training not allowed"]), ({"ai_training": "unknown"}, ["ai_training unknown"]), ({"modification": None}, ["modification unknown"]),
    ({"ai_training": "allowed_under_general_grant"}, ["ai_training_basis missing"]), ({"ai_training": "allowed_under_general_grant", "ai_training_basis": "grant"}, []), ({"attribution": "", "sha256": None}, ["attribution missing", "sha256 missing"]),
    ({"allowed_uses": []}, ["allowed_uses without corpus"]), ({"allowed_uses": [], "kind": "character_table"}, []),
])
def test_licence_gate(spark, change, found):
    row = FINE | change
    df = spark.createDataFrame([tuple(row.values())], GOV)
    assert df.select(gates.issues().alias("i")).first().i == found
    assert gates.production(df).count() == (not found) and gates.production(df, ("law_xml",)).count() == 0


DAILY = "source_id string, dataset_name string, provider string, official_page string, urls array<string>, version string, retrieved_at string, license_name string, license_url string, commercial_use string, modification string, redistribution string, attribution string, training_use string, training_basis string, inference_basis string, data_type string, zh_tw_relevance string, fields_used array<string>, document_identity string, files array<struct<path:string,url:string,sha256:string,bytes:bigint>>, status string, approval_scope string, reason string"
EVERYDAY = {"source_id": "s", "dataset_name": "d", "provider": "p", "official_page": "o", "urls": ["u"], "version": "1", "retrieved_at": "t", "license_name": "l", "license_url": "u", "commercial_use": "yes", "modification": "yes", "redistribution": "conditional", "attribution": "a", "training_use": "yes", "training_basis": "explicit", "inference_basis": "", "data_type": "x", "zh_tw_relevance": "r", "fields_used": ["f"], "document_identity": "i", "files": [("f", "u", "0" * 64, 1)], "status": "APPROVED", "approval_scope": "dev_experiment", "reason": "r"}


@pytest.mark.parametrize(("change", "purpose", "found"), [
    ({}, "dev_experiment", []), ({}, "production", ["approval_scope dev_experiment not for production"]), ({"approval_scope": "production"}, "production", []), ({"status": "HOLD"}, "dev_experiment", ["status HOLD"]),
    ({"version": " Unknown yet"}, "dev_experiment", ["version not settled"]), ({"training_use": "no"}, "dev_experiment", ["training_use = no"]), ({"training_basis": "inferred"}, "dev_experiment", ["inference_basis missing"]),
    ({"training_basis": "unknown"}, "dev_experiment", ["training_basis not settled"]), ({"urls": []}, "dev_experiment", ["no url or file"]), ({"files": [("f", "u", "short", 1)]}, "dev_experiment", ["f without digest"]), ({"fields_used": []}, "dev_experiment", ["fields_used empty"]),
])
def test_everyday_gate(spark, change, purpose, found):
    df = spark.createDataFrame([tuple((EVERYDAY | change).values())], DAILY)
    assert df.select(gates.everyday_issues(purpose).alias("i")).first().i == found
    checked = gates.required(df, gates.everyday_issues(purpose))
    if found:
        with pytest.raises(Exception, match="s:"):
            checked.collect()
    else:
        assert checked.count() == 1
    assert gates.production_ids(df).count() == ((EVERYDAY | change)["approval_scope"] == "production" and purpose == "production" and not found)


def test_registry(spark, tmp_path):
    path = _write(tmp_path, "r.json", json.dumps({"sources": [FINE, FINE | {"id": "b"}]}))
    schema = GOV.replace(" string", ":string").replace(" array", ":array")
    assert {r.id for r in gates.registry(spark, path, schema).collect()} == {"a", "b"}
    twice = _write(tmp_path, "t.json", json.dumps({"sources": [FINE, FINE]}))
    with pytest.raises(Exception, match="registered twice"):
        gates.registry(spark, twice, schema).collect()
    some = spark.createDataFrame([("x", ["a", "b"], ["b", "a"]), ("y", ["c"], ["a"])], "name string, sources array<string>, lm_sources array<string>")
    assert [r.name for r in gates.available(some, ["a", "b"], ["a", "b"]).collect()] == ["x"] and gates.available(some, ["a", "b"], ["a"]).count() == 0


def test_record_discovery(spark, tmp_path):
    path = _write(tmp_path, "a.json", json.dumps({"meta": {"n": 1}, "empty": [], "data": {"rows": [{" k ": "v", "n": 2, "b": True, "x": [1], "z": None}, {"k": "w"}]}, "later": [{"k": "no"}]}))
    assert [dict(r.record) for r in readers.json_records(spark, path).orderBy("position").collect()] == [{"k": "v", "n": "2", "b": "True"}, {"k": "w"}]
    xml = _write(tmp_path, "a.xml", '<r xmlns="https://x.y/z"><head><t>1</t></head><item><q>甲</q><a/></item><item><q>乙</q><a>b</a></item><box><item2><q>n</q></item2></box></r>')
    assert [dict(r.record) for r in readers.xml_records(spark, xml).orderBy("position").collect()] == [{"q": "甲", "a": ""}, {"q": "乙", "a": "b"}]
    assert [dict(r.record) for r in readers.xml_records(spark, xml, "item2").collect()] == [{"q": "n"}]


def _documents(df):
    return [tuple(r) for r in df.orderBy("doc_id", "field", "text").collect()]


def test_raw_documents_by_kind(spark, tmp_path):
    digest = lambda p: hashlib.sha256(open(p, "rb").read()).hexdigest()
    law = io.BytesIO()
    with zipfile.ZipFile(law, "w") as z:
        z.writestr("FalV.xml", "<法規資料><法規><法規名稱>甲法</法規名稱><廢止註記>廢</廢止註記><前言> </前言><法規內容><條文><條文內容>第一條文字</條文內容></條文><條文><條文內容> </條文內容></條文></法規內容></法規><法規><法規名稱> </法規名稱></法規></法規資料>")
    path = _write(tmp_path, "law.zip", law.getvalue())
    assert _documents(readers.raw_documents(spark, "law_xml", path, "s", ("法規名稱", "前言", "條文內容"), digest(path))) == [("s", "甲法#廢止", "條文內容", "第一條文字"), ("s", "甲法#廢止", "法規名稱", "甲法")]
    path = _write(tmp_path, "faq.csv", "﻿q,a\n 問 ,Ans:答\n,\n二,\n")
    assert _documents(readers.raw_documents(spark, "faq_csv", path, "s", ("q", "a"), digest(path))) == [("s", "row0", "a", "答"), ("s", "row0", "q", "問"), ("s", "row2", "q", "二")]
    path = _write(tmp_path, "press.json", json.dumps([{"t": " 稿 "}, {"t": ""}, {"t": "二"}]))
    assert _documents(readers.raw_documents(spark, "press_json", path, "s", ("t",), digest(path))) == [("s", "item0", "t", " 稿 "), ("s", "item2", "t", "二")]
    path = _write(tmp_path, "terms.csv", "中文名稱\n甲；乙; 丙\n")
    assert sorted(t[3] for t in _documents(readers.raw_documents(spark, "term_csv", path, "s", ("中文名稱",), digest(path)))) == ["丙", "乙", "甲"]
    path = _write(tmp_path, "tab.csv", 'a\tb\n"x"\t y\n')
    assert _documents(readers.raw_documents(spark, "tabular", path, "s", ("a", "b"), digest(path))) == [("s", "row0", "a", "x"), ("s", "row0", "b", "y")]
    with pytest.raises(ValueError, match="registered"):
        readers.raw_documents(spark, "tabular", path, "s", ("a",), "0" * 64)
    with pytest.raises(ValueError, match="no corpus source"):
        readers.raw_documents(spark, "none", path, "s", ("a",), digest(path))


def test_character_import(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as archive:
        archive.writestr("a.txt", "1-4421\t4E00\n1-4422 4E8C extra\n2-1\t20000\r\n")
        archive.writestr("b.txt", "1-4421\t4E59\n")
    codes = readers.code_points(readers.zip_members(spark, _write(tmp_path, "m.zip", z.getvalue()), ("a.txt", "b.txt")))
    assert {r.code: r.char for r in codes.collect()} == {"1-4421": "乙", "2-1": "\U00020000"}
    lines = spark.createDataFrame([("1-4421\tㄧˇ",), ("2-1\t˙ㄌㄜ",), ("9-9\tㄧ",), ("1-4421\tabc",), ("1-4421\tㄧˇ",), (" ",)], "value string")
    rows, outcomes = readers.character_import(lines, codes)
    assert [tuple(r) for r in rows.collect()] == [("乙", "ㄧˇ", "1-4421"), ("\U00020000", "ㄌㄜ˙", "2-1")] and {r.outcome: r.n for r in outcomes.collect()} == {"read": 3, "unmapped": 1, "invalid": 1}


def test_variants(spark):
    lines = spark.createDataFrame([("# U+1",), ("U+88E1\tkSimplifiedVariant\tU+91CC",), ("U+91CC\tkTraditionalVariant\tU+88CF<kX U+91CC",), ("U+4E00\tkTraditionalVariant\tU+4E00",)], "value string")
    assert {tuple(r) for r in readers.variants(lines, "kSimplifiedVariant").collect()} == {("裡", "里")} and {r.char for r in readers.simplified_characters(lines).collect()} == {"里"}


def test_lexicon_lines_and_counts(spark, tmp_path):
    path = _write(tmp_path, "w.tsv", "# head\n在\t5\tㄗㄞˋ\n\n在家\t3\n")
    assert [(r.text, r.tier, r.readings, r.line) for r in readers.rated_words(spark, path).orderBy("line").collect()] == [("在", 5, ["ㄗㄞˋ"], 2), ("在家", 3, None, 4)]
    for name, lines in {"unigrams": '"\t3\n', "bigrams": "ab\t2\n", "trigrams": "abc\t1\n", "words": "w\t4\n", "followers": "a\t2\t1\n"}.items():
        _write(tmp_path, f"{name}.tsv.gz", gzip.compress(lines.encode()))
    grams, follow, words = readers.ngram_tables(spark, str(tmp_path))
    assert {tuple(r) for r in grams.collect()} == {(1, '"', 3), (2, "ab", 2), (3, "abc", 1)} and tuple(follow.first()) == ("a", 2, 1) and tuple(words.first()) == ("w", 4)


def test_digests(spark, tmp_path):
    a, b = _write(tmp_path, "a.txt", b"x\r\ny\r\n"), _write(tmp_path, "b.gz", gzip.compress(b"x\ny\n"))
    same = {r.sha256 for p in (a, b) for r in readers.digests(spark, p, normalised=True).collect()}
    assert same == {hashlib.sha256(b"x\ny\n").hexdigest()} and readers.digests(spark, a).first().sha256 == hashlib.sha256(b"x\r\ny\r\n").hexdigest()
    recorded = spark.createDataFrame([("a.txt", "0" * 64), ("c.txt", "1" * 64)], "name string, sha256 string")
    assert {tuple(r) for r in readers.unlike(readers.digests(spark, a), recorded).collect()} == {("a.txt", "changed"), ("c.txt", "missing")}


def test_scenarios_and_cases(spark, tmp_path):
    good = {"id": "a", "context": "x", "target": "他", "target_readings": ["ㄊㄚˉ"], "acceptable_at_t0": ["他"]}
    path = _write(tmp_path, "s.jsonl", "# head\n" + json.dumps(good) + "\n")
    row = readers.scenarios(spark, path).first()
    assert row.target_readings == ["ㄊㄚ"] and row.suffix == "" and row.final_answers == []
    for bad, why in (({"acceptable_at_t0": ["她"]}, "target_not_acceptable"), ({"target_readings": ["x"]}, "reading")):
        with pytest.raises(Exception, match=why):
            readers.scenarios(spark, _write(tmp_path, "bad.jsonl", json.dumps(good | bad))).collect()
    case = {"case_id": "c", "left_context": "", "readings": ["a"], "candidates": ["x", "y"], "baseline_scores": [0.0, -1.0], "answers": ["x"], "target": "x", "target_length": 1, "ambiguous_at_t0": False}
    assert readers.ranking_cases(spark, _write(tmp_path, "c.jsonl", json.dumps(case))).first().tags == []
    for bad, why in (({"candidates": ["x", "x"]}, "repeated_candidates"), ({"answers": ["z"]}, "answers"), ({"baseline_scores": [0.0]}, "scores")):
        with pytest.raises(Exception, match=why):
            readers.ranking_cases(spark, _write(tmp_path, "bad.jsonl", json.dumps(case | bad))).collect()
    with pytest.raises(Exception, match="stands twice"):
        readers.ranking_cases(spark, _write(tmp_path, "two.jsonl", (json.dumps(case) + "\n") * 2)).collect()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("c", "x y")], "case_id string, text string")
    writers.cases(rows, str(tmp_path / "cases"), "one\ntwo")
    lines = [r.value for r in spark.read.text(str(tmp_path / "cases")).collect()]
    assert sorted(lines) == ["# one", "# two", '{"case_id":"c","text":"x y"}']
    assert readers.commented_jsonl(spark, str(tmp_path / "cases"), "case_id string, text string").first().text == "x y"
    chars = spark.createDataFrame([("一", "ㄧ", "1-1")], "char string, reading string, cns_code string")
    writers.char_readings(chars, str(tmp_path / "chars"), "licence")
    assert tuple(readers.char_readings(spark, str(tmp_path / "chars")).first()) == ("一", "ㄧ", "1-1")
    grams = spark.createDataFrame([(1, "a", 3), (2, "ab", 2)], "n int, gram string, c long")
    writers.ngram_table(grams, str(tmp_path / "grams"), {"name": "t"})
    assert json.loads((tmp_path / "grams.manifest.json").read_text()) == {"name": "t", "grams": {"1": 1, "2": 1}, "tokens": 3}
    text = spark.createDataFrame([("s1", "train", "d", "x", "u"), ("s2", "dev", "d", "y", "u")], "source_id string, split string, doc_id string, text string, contributor string")
    writers.sentences(text, str(tmp_path / "corpus"))
    back = spark.read.json(str(tmp_path / "corpus"))
    assert "contributor" not in back.columns and back.filter("source_id = 's2'").first().text == "y"
    folder = tmp_path / "all" / "s1"
    folder.mkdir(parents=True)
    (folder / "sentences.jsonl").write_text('{"text": "z"}\n')
    assert readers.corpus_sentences(spark, str(tmp_path / "all"), "text string", ("s1",)).first().text == "z" and readers.corpus_sentences(spark, str(tmp_path / "all"), "text string").count() == 1


def test_normalised_text(spark):
    from inkspark.functions import text as tx

    raw = "<p>é &eacute;&hellip;&#x4E2D;</p>A，中,中 http://x.y/z"
    assert spark.createDataFrame([(raw,)], "t string").select(tx.normalised("t").alias("t")).first().t == "é é…中\nA，中，中"
    rows = [("a;\nb}",), ("a; b",), ("x == y => z",), ("fine",)]
    assert [r.p for r in spark.createDataFrame(rows, "t string").select(tx.problems("t").alias("p")).collect()] == [["markup_or_code"], [], ["markup_or_code"], []]
