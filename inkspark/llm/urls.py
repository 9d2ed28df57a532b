"""URL filters (operator 10): rules first, then host word segmentation and multinomial naive Bayes.

The names of a host and of its path, runs of letters, are split into words by unigram Viterbi: the word counts come
from all pages' titles and paths, and a part that is no known word costs the more the longer it is. Naive Bayes adds
the log odds of the words of host and path. It is fitted on labelled urls, which the query takes from the pages that
rules decide: the classifier carries the rules' verdicts over to what is named alike. The rules' own names are no
evidence then, as the labels follow from them. `sample` labelled rows are used, those of the least hashes (a bounded
sample, kept by a threshold on the hash); counts for segmentation come from all rows.

Names, words, urls and odds are tables throughout: each distinct name is split once, and a url's names meet their odds
under salted keys, as a name like a language code may stand in a third of all urls.

Defined cases: a null url, or one without "://", has an empty host and path and no evidence but the prior; repeated
rows get equal results; words that the labelled rows lack are no evidence; without labelled rows all odds are 0 and
nothing is blocked; names of any length are split whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.sources.shared import written

#: Fixed values: (host, path, verdict) rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LONGEST_WORD = 63  # letters of a known word: what a part of a host name can hold
WINDOW = 512  # letters of a name that are looked up at a time, beside LONGEST_WORD of the next ones
SAMPLE = 200_000  # labelled rows that the classifier is fitted on, or nearly
SMOOTHING = 0.5  # what is added to each count
SALTS = 16


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path and title of each row."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    host = F.regexp_extract(F.col("rest"), "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(F.col("rest"), F.length(host) + 1, F.length("rest")), "^[^?#]*", 0)
    title = F.regexp_extract("html", "<title>([^<]*)", 1) if "html" in pages.columns else F.lit("")
    out = pages.select("page_id", F.coalesce(title, F.lit("")).alias("title"), F.coalesce(rest, F.lit("")).alias("rest"))
    return out.withColumns({"host": F.translate(host, *lower), "path": path}).select("page_id", "host", "path", "title")


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    return F.coalesce(*fits)


def names_of(text: Column) -> Column:
    """Runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def word_counts(rows: DataFrame) -> DataFrame:
    """word, n over all titles and paths."""
    words = rows.select(F.explode(names_of(F.concat_ws(" ", "title", "path"))).alias("word"))
    return words.filter(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split_name(length: int, parts: list[tuple[int, int, float]], total: float) -> list[tuple[int, int]]:
    """Bounds of the likeliest words; parts: (start, end, count) of known words within the name.

    A known word scores log10(n / total); an unknown one 1 - log10(total) less one for each letter, whatever its
    length. Ties go to fewer words, then to the later start of the last one.
    """
    total = max(total, 1.0)
    at_end: dict[int, list[tuple[int, float]]] = {}
    for a, b, n in parts:
        at_end.setdefault(b, []).append((a, math.log10(n / total)))
    fresh = 1 - math.log10(total)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    run = (-math.inf, 0, 0)  # the best unknown word that ends here: its score, -words, start
    for end in range(1, length + 1):
        opened = (best[end - 1][0] + fresh - 1, best[end - 1][1] - 1, end - 1)
        run = max(opened, (run[0] - 1, run[1], run[2]))
        best.append(max([run, *((best[a][0] + cost, best[a][1] - 1, a) for a, cost in at_end.get(end, ()))]))
    out, end = [], length
    while end:
        out.append((best[end][2], end))
        end = best[end][2]
    return out[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name, words of each distinct name.

    Long names are looked up in windows that overlap by the longest known word, so that no word is cut.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    once = names.select("name").filter("name <> ''").distinct()
    windows = once.withColumn("k", F.explode(F.expr(f"sequence(0, cast((length(name) - 1) / {WINDOW} as int))")))
    windows = windows.select("name", "k", F.expr(f"substring(name, k * {WINDOW} + 1, {WINDOW + LONGEST_WORD - 1})").alias("w"))
    at = F.explode(F.expr(f"flatten(transform(sequence(1, least({WINDOW}, length(w))), i -> transform(sequence(i, least(length(w), i + {LONGEST_WORD} - 1)), j -> struct(i - 1 as a, j as b, substring(w, i, j - i + 1) as word))))"))
    parts = windows.select("name", "k", at.alias("at")).select("name", (F.col("at.a") + F.col("k") * WINDOW).alias("a"), (F.col("at.b") + F.col("k") * WINDOW).alias("b"), "at.word")
    known = parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("a", "b", "n")).alias("parts"))
    every = once.join(known, "name", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<a:int,b:int,n:bigint>>")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = [[r.name[a:b] for a, b in split_name(len(r.name), [(p["a"], p["b"], p["n"]) for p in r.parts], float(r.total))] for r in frame.itertuples(index=False)]
            yield pd.DataFrame({"name": frame["name"], "words": words})

    return every.crossJoin(F.broadcast(total)).mapInPandas(run, "name string, words array<string>")


def fitted(labelled: DataFrame, split: DataFrame, without: tuple[str, ...] = (), smoothing: float = SMOOTHING) -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes of `labelled` (names, verdict, copies): (word, odds) of the words but `without`, and a
    row with `prior`, log odds of block."""
    blocked = F.col("verdict") == "block"
    count = lambda of: F.sum(F.when(of, F.col("copies")).otherwise(0))
    names = labelled.select("verdict", "copies", F.explode("names").alias("name")).groupBy("name").agg(count(blocked).alias("b"), count(~blocked).alias("a"))
    words = names.join(split, "name").select("a", "b", F.explode("words").alias("word"))
    words = words.filter(~F.col("word").isin(*without)) if without else words
    per = words.groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    sums = per.agg(F.sum("b").alias("sb"), F.sum("a").alias("sa"), F.count(F.lit(1)).alias("v"))
    share = lambda n, of: F.ln((F.col(n) + smoothing) / (F.col(of) + smoothing * F.col("v")))
    odds = per.crossJoin(F.broadcast(sums)).select("word", (share("b", "sb") - share("a", "sa")).alias("odds"))
    sizes = labelled.agg(count(blocked).alias("b"), count(~blocked).alias("a"))
    return odds, sizes.select(F.when(F.col("a") + F.col("b") > 0, F.ln((F.col("b") + smoothing) / (F.col("a") + smoothing))).otherwise(0.0).alias("prior"))


def _sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """`labelled` urls (host, path, verdict, copies) of the least hashes: `sample` rows or nearly, without a sort."""
    rows = labelled.agg(F.sum("copies")).first()[0] or 0
    if rows <= sample:
        return labelled
    return labelled.filter(F.pmod(F.xxhash64("host", "path"), F.lit(1 << 32)) < int((1 << 32) * sample / rows))


def judged(pages: DataFrame, rules: tuple = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, host_words and log_odds (of block) of each row.

    labelled: (url, verdict) rows to fit on; without it those of `pages` that a rule decides.
    """
    rows = parsed(pages)
    hit = rule_of(F.col("host"), F.col("path"), rules)
    counts = written(word_counts(rows), "url-words")
    names = names_of(F.concat_ws(" ", "host", "path"))
    urls = written(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("copies")), "urls")
    without: tuple[str, ...] = ()
    if labelled is None:
        without = tuple(sorted({w for h, p, _ in rules for w in re.findall(r"[^\W\d_]+", f"{h} {p}".lower())}))
        taught = urls.select("host", "path", hit["verdict"].alias("verdict"), "copies").filter("verdict is not null")
    else:
        taught = parsed(labelled.select(F.col("verdict").alias("page_id"), "url")).select("host", "path", F.col("page_id").alias("verdict")).filter("verdict is not null").groupBy("host", "path", "verdict").agg(F.count(F.lit(1)).alias("copies"))
    taught = _sampled(taught, sample).select("verdict", "copies", names.alias("names"))
    split = written(segmented(urls.select(F.explode(names).alias("name")).union(taught.select(F.explode("names"))), counts), "url-names")
    odds, prior = fitted(taught, split, without)
    known = split.select("name", F.explode("words").alias("word")).join(odds, "word").groupBy("name").agg(F.sum(F.round("odds", 9)).alias("odds"))
    per_name = split.join(known, "name", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.size(names_of(F.col("host")))
    each = urls.select("host", "path", own.alias("own"), F.posexplode(names).alias("i", "name"), F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int").alias("salt"))
    scores = each.join(per_name, ["name", "salt"]).groupBy("host", "path").agg(F.sum("odds").alias("odds"), F.array_sort(F.collect_list(F.when(F.col("i") < F.col("own"), F.struct("i", "words")))).alias("w"))
    scores = written(scores.select("host", "path", "odds", F.array_join(F.flatten(F.transform("w", lambda x: x["words"])), " ").alias("host_words")), "url-odds")
    met = rows.select("page_id", "host", "path").join(scores, ["host", "path"], "left").crossJoin(F.broadcast(prior))
    ruled = met.withColumns({"hit": hit, "log_odds": F.round(F.col("prior") + F.coalesce("odds", F.lit(0.0)), 6)})
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "host_words", "log_odds")
