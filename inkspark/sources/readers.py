"""Readers of raw corpora: each gives a DataFrame of strings, with ordinals where later steps need the order."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tags of the law collection, and the members of the character-code archive (the private plane is not read).
LAW, LAW_NAME, LAW_PREAMBLE, LAW_ARTICLE, LAW_REPEAL_NOTE, LAW_REPEALED = "法規", "法規名稱", "前言", "條文內容", "廢止註記", "#廢止"


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line; only LF ends a line."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST").json(path)


def commented_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The same without blank lines and lines that start with #; a malformed line is an error."""
    lines = spark.read.option("lineSep", "\n").text(path).filter("trim(value) <> '' and not startswith(trim(value), '#')")
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def decoded(spark: SparkSession, path: str, preferred: str = "utf-8", others: tuple[str, ...] = ("utf-8-sig", "cp950", "big5hkscs")) -> DataFrame:
    """path, text of whole files: the first charset that fits; a file that none fits is an error."""
    @F.pandas_udf("string")
    def text(raw: pd.Series) -> pd.Series:
        def one(data: bytes) -> str:
            for name in (preferred, *others):
                try:
                    return bytes(data).decode(name)
                except UnicodeDecodeError:
                    continue
            raise ValueError("no charset fits")

        return raw.map(one)

    return spark.read.format("binaryFile").load(path).select("path", text("content").alias("text"))


def delimited(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Rows with a header, all strings: tab where the header has tabs and no comma, else comma; nulls are empty."""
    head = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    first = head[0][0] if head else ""
    sep = "\t" if "\t" in first and "," not in first else ","
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, escape='"')
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.strip().lstrip("﻿")) for c in df.columns))


def _whole(spark: SparkSession, path: str, rows: Callable[[bytes], Iterator[dict[str, str]]]) -> DataFrame:
    """position, record (a map) of whole files that Python has to take apart: each file is one task's."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                found = list(rows(bytes(content)))
                yield pd.DataFrame({"position": range(len(found)), "record": found})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "position long, record map<string,string>")


def json_records(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """position, record (a map) of the first array of objects found depth first; scalars as strings, the rest left out."""
    def find(data: object) -> list[dict[str, str]]:
        if isinstance(data, list):
            objects = bool(data) and all(isinstance(x, dict) for x in data)
            return [{str(k).strip(): str(v) for k, v in x.items() if isinstance(v, str | int | float)} for x in data] if objects else []
        for value in data.values() if isinstance(data, dict) else ():
            if found := find(value):
                return found
        return []

    return _whole(spark, path, lambda raw: iter(find(json.loads(raw.decode(encoding)))))


def xml_records(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """position, record (a map) of the elements of a tag; without one, of the commonest tag (then the least) whose
    elements have leaves only. Namespaces go."""
    def rows(raw: bytes) -> Iterator[dict[str, str]]:
        import xml.etree.ElementTree as ET

        root = ET.fromstring(raw)
        local = lambda t: t.rsplit("}", 1)[-1].strip()
        flat = Counter(e.tag for e in root.iter() if len(e) and not any(len(c) for c in e))
        chosen = [t for t in flat if local(t) == tag] if tag else [min(flat, key=lambda t: (-flat[t], t))] if flat else []
        for e in root.iter():
            if e.tag in chosen:
                yield {local(c.tag): c.text or "" for c in e}

    return _whole(spark, path, rows)


def zip_members(spark: SparkSession, path: str, members: tuple[str, ...], encoding: str = "utf-8-sig") -> DataFrame:
    """member, position, value: the lines of named members of zip archives, in the order given."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for k, member in enumerate(members):
                        lines = archive.read(member).decode(encoding).split("\n")
                        yield pd.DataFrame({"member": k, "position": range(len(lines)), "value": [x.rstrip("\r") for x in lines]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "member int, position long, value string")


def laws(spark: SparkSession, path: str, source: str, fields: tuple[str, ...], member: str = "FalV.xml") -> DataFrame:
    """source_id, doc_id, field, text of a zipped law collection: name, preamble and each article as far as `fields` has
    them; a repealed law's doc_id says so. Laws without a name are left out."""
    def rows(raw: bytes) -> Iterator[dict[str, str]]:
        import io
        import xml.etree.ElementTree as ET
        import zipfile

        with zipfile.ZipFile(io.BytesIO(raw)) as archive, archive.open(member) as handle:
            root = ET.parse(handle).getroot()
        for law in root.iter(LAW):
            text = lambda tag: law.findtext(tag) or ""  # noqa: B023, E731
            name = text(LAW_NAME).strip()
            doc = name + (LAW_REPEALED if text(LAW_REPEAL_NOTE).strip() else "")
            each = [(LAW_NAME, name), (LAW_PREAMBLE, text(LAW_PREAMBLE)), *((LAW_ARTICLE, a.text or "") for a in law.iter(LAW_ARTICLE))]
            yield from ({"doc_id": doc, "field": f, "text": t} for f, t in each if name and f in fields and t.strip())

    found = _whole(spark, path, rows)
    return found.select(F.lit(source).alias("source_id"), *(F.col("record")[k].alias(k) for k in ("doc_id", "field", "text")))


def unpivoted(records: DataFrame, source: str, doc: Column | str, fields: tuple[str, ...], strip: bool = True, prefix: str = "", quotes: bool = False) -> DataFrame:
    """source_id, doc_id, field, text: a row for each field with text; `prefix` goes from the start, and with `quotes`
    those around the text. records: columns by field, or a map `record`."""
    value = (lambda f: F.try_element_at("record", F.lit(f))) if "record" in records.columns else (lambda f: F.col(f"`{f}`"))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), value(f).alias("text")) for f in fields)))
    rows = records.select(F.lit(source).alias("source_id"), (F.col(doc) if isinstance(doc, str) else doc).alias("doc_id"), each.alias("f")).select("source_id", "doc_id", "f.*")
    bare = lambda c: F.regexp_replace(c, r"^[\s\x{3000}\x{A0}]+|[\s\x{3000}\x{A0}]+$", "")
    text = bare(F.col("text")) if strip else F.col("text")
    text = F.regexp_replace(text, f"^{prefix}", "") if prefix else text
    text = F.regexp_replace(text, '^"+|"+$', "") if quotes else text
    return rows.withColumn("text", text).filter(F.col("text").isNotNull() & (bare(F.col("text")) != ""))


def raw_documents(spark: SparkSession, kind: str, path: str, source: str, fields: tuple[str, ...], digest: str, file_format: str = "", encoding: str = "utf-8-sig") -> DataFrame:
    """source_id, doc_id, field, text of a registered source, by its kind; the file must have the registered SHA-256."""
    actual = digests(spark, path).first()
    if actual is None or actual["sha256"] != digest:
        raise ValueError(f"{source}: the file is not the registered one")
    if kind == "law_xml":
        return laws(spark, path, source, fields)
    if kind == "press_json":
        return unpivoted(json_records(spark, path, encoding), source, F.concat(F.lit("item"), "position"), fields, strip=False)
    if kind == "faq_csv":
        return unpivoted(delimited_records(spark, path, encoding, ","), source, F.concat(F.lit("row"), "position"), fields, prefix="Ans:")
    if kind == "term_csv":
        return terms(delimited_records(spark, path, encoding, ",").select(F.concat(F.lit("row"), "position").alias("doc"), F.try_element_at("record", F.lit(fields[0])).alias(fields[0])), source, "doc", fields[0])
    if kind == "tabular":
        reader = {"JSON": lambda: json_records(spark, path, encoding), "XML": lambda: xml_records(spark, path)}.get(file_format.upper(), lambda: delimited_records(spark, path, encoding))
        return unpivoted(reader(), source, F.concat(F.lit("row"), "position"), fields, quotes=True)
    raise ValueError(f"{source}: {kind} is no corpus source")


def delimited_records(spark: SparkSession, path: str, encoding: str = "utf-8-sig", sep: str | None = None) -> DataFrame:
    """position, record (a map) of one delimited file in its order; keys are stripped and nulls empty."""
    def rows(raw: bytes) -> Iterator[dict[str, str]]:
        import csv
        import io

        text = raw.decode(encoding)
        head = text.split("\n", 1)[0]
        by = sep or ("\t" if "\t" in head and "," not in head else ",")
        for row in csv.DictReader(io.StringIO(text), delimiter=by):
            yield {str(k).strip(): v or "" for k, v in row.items() if k is not None and not isinstance(v, list)}

    return _whole(spark, path, rows)


def digests(spark: SparkSession, path: str, normalised: bool = False) -> DataFrame:
    """path, sha256 of files; normalised: of what gzip holds, with CRLF as LF, so that packing and breaks don't count."""
    files = spark.read.format("binaryFile").load(path)
    if not normalised:
        return files.select("path", F.sha2("content", 256).alias("sha256"))

    @F.pandas_udf("binary")
    def plain(raw: pd.Series) -> pd.Series:
        import gzip

        return raw.map(lambda b: (gzip.decompress(b) if bytes(b[:2]) == b"\x1f\x8b" else bytes(b)).replace(b"\r\n", b"\n"))

    return files.select("path", F.sha2(plain("content"), 256).alias("sha256"))


def unlike(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """name, problem: recorded files (name, sha256) that are missing or changed among those found (path, sha256)."""
    now = found.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("sha256").alias("now"))
    return recorded.join(now, "name", "left").filter("now is null or now <> sha256").select("name", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("problem"))


def code_points(lines: DataFrame) -> DataFrame:
    """code, char of lines (member, position, value) with a code and a hexadecimal code point; the last line counts."""
    parts = lines.select("member", "position", F.filter(F.split("value", r"\s+"), lambda p: p != "").alias("p")).filter("size(p) = 2")
    last = parts.groupBy(F.get("p", 0).alias("code")).agg(F.max_by(F.get("p", 1), F.struct("member", "position")).alias("hex"))
    return last.select("code", F.decode(F.unhex(F.lpad("hex", 8, "0")), "UTF-32").alias("char"))


def character_import(readings: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(char, reading, cns_code in the order of plane, code and reading; outcome, n): readings are lines (value) of a
    code and a syllable, joined to characters; codes without one are unmapped, syllables that are none invalid."""
    from inkspark.functions import phonetics

    cut = readings.filter("trim(value) <> ''").select(F.split("value", "\t").alias("p")).select(F.get("p", 0).alias("cns_code"), F.get("p", 1).alias("raw"))
    met = cut.join(codes.withColumnRenamed("code", "cns_code"), "cns_code", "left").withColumn("reading", phonetics.canonical("raw"))
    outcome = F.when(F.col("char").isNull(), "unmapped").when(F.col("reading").isNull(), "invalid").otherwise("read")
    plane = F.split_part("cns_code", F.lit("-"), F.lit(1)).cast("int")
    rows = met.filter("char is not null and reading is not null").select("char", "reading", "cns_code").distinct().orderBy(plane, "cns_code", "reading")
    return rows, met.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def variants(lines: DataFrame, field: str) -> DataFrame:
    """char, other: a character database's variants of one field (tab-separated, targets with sources after <), but for
    characters that are their own."""
    cut = lines.filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p")).filter((F.size("p") == 3) & (F.get("p", 1) == field))
    point = lambda c: F.decode(F.unhex(F.lpad(F.substring(c, 3, 8), 8, "0")), "UTF-32")
    each = cut.select(point(F.get("p", 0)).alias("char"), F.explode(F.split(F.get("p", 2), " +")).alias("t"))
    return each.select("char", point(F.split_part("t", F.lit("<"), F.lit(1))).alias("other")).filter("char <> other").distinct()


def simplified_characters(lines: DataFrame) -> DataFrame:
    """char: those with a traditional variant that is another character."""
    return variants(lines, "kTraditionalVariant").select("char").distinct()


def terms(records: DataFrame, source: str, doc: str, column: str) -> DataFrame:
    """One row for each term between full-width or ASCII semicolons."""
    cut = records.select(F.lit(source).alias("source_id"), F.col(doc).alias("doc_id"), F.lit(column).alias("field"), F.explode(F.split(F.col(column), "[；;]")).alias("text"))
    return cut.withColumn("text", F.trim("text")).filter("text <> ''")


def traditional_sentences(sentences: DataFrame, transcriptions: DataFrame) -> DataFrame:
    """Sentences (id, lang, text, user) in cmn that have a simplified transcription: those written in traditional."""
    has = transcriptions.filter("script = 'Hans'").select("id")
    return sentences.filter("lang = 'cmn'").join(has, "id", "left_semi").select("id", "text", F.when(F.col("user") == "\\N", "").otherwise(F.col("user")).alias("contributor"))


def prompts(messages: DataFrame) -> DataFrame:
    """Reviewed human prompts in zh, with a short hash for the contributor."""
    fit = (F.col("lang") == "zh") & (F.col("role") == "prompter") & ~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("synthetic", F.lit(False)) & F.col("review_result")
    return messages.filter(fit).select("message_id", "text", F.substring(F.sha1(F.col("user_id")), 1, 12).alias("contributor"))


def read_aloud(rows: DataFrame) -> DataFrame:
    """sentence_id, sentence: the first of each id, then of each text, in file order (`position`)."""
    by_id = rows.groupBy("sentence_id").agg(F.min(F.struct("position", "sentence")).alias("f")).select("sentence_id", "f.*")
    return by_id.groupBy("sentence").agg(F.min(F.struct("position", "sentence_id")).alias("f")).select("f.sentence_id", "sentence")


def char_readings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", quote="", schema="char string, reading string, cns_code string")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1), value of one text file, in its order."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                lines = bytes(content).decode("utf-8-sig").split("\n")
                yield pd.DataFrame({"line": range(1, len(lines) + 1), "value": [x.rstrip("\r") for x in lines]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "line long, value string")


def rated_words(spark: SparkSession, path: str) -> DataFrame:
    """text, tier, readings (null where the line has none), line."""
    cut = numbered_lines(spark, path).filter("trim(value) <> '' and not startswith(value, '#')").select("line", F.split("value", "\t").alias("p"))
    readings = F.trim(F.coalesce(F.get("p", 2), F.lit("")))
    return cut.select(F.get("p", 0).alias("text"), F.get("p", 1).cast("int").alias("tier"), F.when(readings != "", F.split(readings, " +")).alias("readings"), "line")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """gram, c from plain or gzipped TSV; quotes are characters like any other."""
    return spark.read.csv(path, sep="\t", quote="", schema="gram string, c long")


def ngram_tables(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(n, gram, c; history, total, types; word, c) of a directory of count files, plain or gzipped."""
    from functools import reduce

    base = directory.rstrip("/")
    grams = reduce(DataFrame.unionByName, [counts(spark, f"{base}/{name}.tsv*").select(F.lit(n).alias("n"), "gram", "c") for n, name in enumerate(("unigrams", "bigrams", "trigrams"), 1)])
    follow = spark.read.csv(f"{base}/followers.tsv*", sep="\t", quote="", schema="history string, total long, types long")
    return grams, follow, counts(spark, f"{base}/words.tsv*").withColumnRenamed("gram", "word")


def corpus_sentences(spark: SparkSession, root: str, schema: str, sources: tuple[str, ...] | None = None) -> DataFrame:
    """Sentences of all sources' folders under `root`, or only of those named: other folders are not read."""
    names = "*" if sources is None else "{" + ",".join(sources) + "}"
    return jsonl(spark, f"{root.rstrip('/')}/{names}/sentences.jsonl", schema)


SCENARIO = "id string, context string, target string, target_readings array<string>, suffix string, suffix_readings array<string>, acceptable_at_t0 array<string>, tags array<string>, final_answers array<string>"
CASE = "case_id string, left_context string, readings array<string>, candidates array<string>, baseline_scores array<double>, answers array<string>, target string, target_length int, ambiguous_at_t0 boolean, tags array<string>, target_variants array<string>"


def _without_issues(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """`rows`, an error where one has an issue or an id stands twice."""
    from inkspark.operators.sets import once

    why = issues.groupBy("case_id").agg(F.array_join(F.sort_array(F.collect_set("issue")), ", ").alias("__why"))
    met = once(rows, "case_id").join(why, "case_id", "left")
    stop = F.raise_error(F.concat_ws(": ", "case_id", "__why"))
    return met.withColumn("case_id", F.when(F.col("__why").isNotNull(), stop).otherwise(F.col("case_id"))).select(*rows.columns)


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenarios with readings in their usual writing; one that breaks a rule is an error."""
    from inkspark.functions import phonetics
    from inkspark.operators.sets import scenario_issues

    raw = commented_jsonl(spark, path, SCENARIO)
    none = F.array().cast("array<string>")
    usual = lambda c: F.transform(F.coalesce(c, none), phonetics.canonical)
    rows = raw.select(F.col("id").alias("case_id"), "context", "target", usual("target_readings").alias("target_readings"), F.coalesce("suffix", F.lit("")).alias("suffix"), usual("suffix_readings").alias("suffix_readings"), "acceptable_at_t0", F.coalesce("tags", none).alias("tags"), F.coalesce("final_answers", none).alias("final_answers"))
    unread = rows.filter(F.exists(F.concat("target_readings", "suffix_readings"), lambda r: r.isNull())).select("case_id", F.lit("reading").alias("issue"))
    return _without_issues(rows, scenario_issues(rows).unionByName(unread))


def ranking_cases(spark: SparkSession, path: str) -> DataFrame:
    """Ranking cases; one that breaks a rule is an error."""
    from inkspark.operators.sets import case_issues

    rows = commented_jsonl(spark, path, CASE)
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("tags", "target_variants")})
    return _without_issues(rows, case_issues(rows))


def archive_rows(spark: SparkSession, path: str, member: str) -> DataFrame:
    """Lines of one member (by the end of its name) of tar.gz archives, streamed through the archive."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import tarfile

        for frame in frames:
            for content in frame["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|gz") as archive:
                    for entry in archive:
                        if entry.name.endswith(member):
                            lines = archive.extractfile(entry).read().decode("utf-8").split("\n")
                            yield pd.DataFrame({"position": range(len(lines)), "value": lines})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "position long, value string").filter("value <> ''")
