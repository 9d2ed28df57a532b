"""Text functions as column expressions. Every script-dependent one takes the script's character class."""

from __future__ import annotations

import html
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Character classes; han is the one of normalisation, han_bmp and han_wide those of other stages.
SCRIPTS = {
    "han": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{3134F}\x{F900}-\x{FAFF}",
    "han_bmp": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}",
    "han_wide": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2FFFF}",
    "latin": r"A-Za-zÀ-ÿ",
}
#: What counts as white space in any script, as regular expressions' \s is ASCII only here.
SPACE = r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Marks of a sentence's ends; full-width letters and digits; marks that become wide; list markers.
BEGIN, END = "^", "$"
FULL_DIGITS = "".join(chr(c) for r in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(*r))
WIDE_MARKS = {",": "，", "?": "？", "!": "！", ":": "：", ";": "；", "(": "（", ")": "）"}
LIST_MARKER = rf"^[{SPACE}]*(?:第[{SPACE}]*[0-9一二三四五六七八九十百千]+[{SPACE}]*[條項款目編章節][{SPACE}]*|[（(]?[0-9一二三四五六七八九十]+[)）、.．][{SPACE}]*)+"
#: Patterns of problem documents.
URL, EMAIL = r"(?i)https?://|www\.", r"[\w.+-]+@[\w-]+\.[\w.]+"
MARKUP = r"</?[a-zA-Z][^>]*>|```|&[a-z]+;|\[[^\]]*\]\([^)]*\)"
CODE = r"(?m)\b(?:def|import|return|function|class|print)\b|[;{}]\s*$|==|=>"
PERSONAL_ID = r"\b[A-Z][12]\d{8}\b"
PHONE = r"(?:\+?886[-\s]?|0)9\d{2}[-\s]?\d{3}[-\s]?\d{3}|\(?0\d{1,2}\)?[-\s]?\d{3,4}[-\s]?\d{4}"
LONG_NUMBER = r"\d{6,}"
#: Fixed value: character references that end in a semicolon.
REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def is_script(ch: Column | str, script: str = "han") -> Column:
    return F.rlike(_c(ch), F.lit(f"^[{SCRIPTS[script]}]$"))


def script_key(text: Column | str, script: str = "han") -> Column:
    """Only the script's characters: the key of duplicates."""
    return F.regexp_replace(_c(text), f"[^{SCRIPTS[script]}]+", "")


def script_ratio(text: Column | str, script: str = "han") -> Column:
    """The script's characters among those that aren't white space; 0 without any."""
    seen = F.length(F.regexp_replace(_c(text), f"[{SPACE}]", ""))
    return F.when(seen > 0, F.length(script_key(text, script)) / seen).otherwise(F.lit(0.0))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text: Column | str) -> Column:
    """Unicode's composed form."""
    return _composed(_c(text))


@F.pandas_udf(StringType())
def _unescaped_closed(texts: pd.Series) -> pd.Series:
    put = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]
    return texts.map(lambda t: REFERENCE.sub(put, t), na_action="ignore")


def strip_markup(text: Column | str, closed: bool = False) -> Column:
    """Block tags become breaks, other tags go, and all character references are put back; with `closed` only those
    that end in a semicolon, so that `&ampp` stays as it is."""
    out = F.regexp_replace(_c(text), r"(?i)</?(?:p|br|div|li|tr|h[1-6])\b[^>]*>", "\n")
    return (_unescaped_closed if closed else _unescaped)(F.regexp_replace(out, r"<[^>]+>", ""))


def wide_marks(text: Column | str, script: str = "han") -> Column:
    """ASCII marks right after the script's characters become full width."""
    out = _c(text)
    for mark, wide in WIDE_MARKS.items():
        out = F.regexp_replace(out, rf"(?<=[{SCRIPTS[script]}])\{mark}", wide)
    return out


def normalised(text: Column | str, script: str = "han") -> Column:
    """Composed form, breaks, markup, addresses, widths and spaces."""
    out = strip_markup(F.regexp_replace(composed(text), r"\r\n?", "\n"))
    out = F.regexp_replace(F.regexp_replace(out, rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+", " "), r"(?U)[\w.+-]+@[\w-]+\.[\w.]+", " ")
    out = wide_marks(F.translate(out, FULL_DIGITS, "".join(chr(ord(c) - 0xFEE0) for c in FULL_DIGITS)), script)
    out = F.regexp_replace(out, r"[ \t\x{3000}\x{A0}]+", " ")
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), stripped), lambda x: x != ""), "\n")


def sentences(text: Column | str, script: str = "han", ends: str = "。！？；", comma: str = "，", least: int = 4, most: int | None = 120, ratio: float = 0.6) -> Column:
    """Usable sentences of normalised text: cut after an end mark or at a break, long ones packed again at commas; with
    `most` None they stay whole however long they are."""
    cut = F.split(_c(text), rf"(?<=[{ends}])|\n")
    clean = F.filter(F.transform(cut, lambda x: stripped(F.regexp_replace(x, LIST_MARKER, ""))), lambda x: x != "")
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def pack(state: Column, part: Column) -> Column:
        full = (state["held"] != "") & (F.length(state["held"]) + F.length(part) > most)
        return F.struct(F.when(full, F.concat(state["out"], F.array(state["held"]))).otherwise(state["out"]).alias("out"), F.when(full, part).otherwise(F.concat(state["held"], part)).alias("held"))

    packed = lambda x: F.aggregate(F.split(x, f"(?<=[{comma}])"), empty, pack, lambda s: F.when(s["held"] != "", F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]))
    pieces = clean if most is None else F.flatten(F.transform(clean, lambda x: F.when(F.length(x) <= most, F.array(x)).otherwise(packed(x))))
    return F.filter(pieces, lambda x: (F.length(script_key(x, script)) >= least) & (script_ratio(x, script) >= ratio))


def split_of(source: Column | str, doc: Column | str, dev: int = 5, test: int = 5) -> Column:
    """train, dev or test of a whole document, from SHA-256 modulo 100."""
    digits = F.split(F.sha2(F.concat(_c(source), F.lit("\0"), _c(doc)), 256), "")
    bucket = F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda a, d: (a * 16 + F.conv(d, 16, 10).cast("int")) % 100)
    return F.when(bucket < test, "test").when(bucket < test + dev, "dev").otherwise("train")


def tokens(text: Column | str) -> Column:
    """Characters, with runs of digits and of ASCII letters as one token each (0 and A)."""
    out = F.regexp_replace(F.regexp_replace(_c(text), r"[0-9]+(?:[.,][0-9]+)*", "0"), "[A-Za-z]+", "A")
    return F.filter(F.split(F.regexp_replace(out, rf"[{SPACE}^$]", ""), ""), lambda t: t != "")


def padded(toks: Column, order: int) -> Column:
    return F.concat(F.array_repeat(F.lit(BEGIN), order - 1), toks, F.array(F.lit(END)))


def runs(text: Column | str, script: str = "han") -> Column:
    return F.regexp_extract_all(_c(text), F.lit(f"[{SCRIPTS[script]}]+"), F.lit(0))


def grams(text: Column | str, n: int) -> Column:
    """Character n-grams of a text, repeats included, in one pass: every place, but for the second half of a
    surrogate pair, looks ahead at n characters."""
    return F.regexp_extract_all(_c(text), F.lit(rf"(?s)(?!\p{{Cs}})(?=(.{{{n}}}))"), F.lit(1))


def shingles(text: Column | str, n: int = 4, script: str = "han") -> Column:
    """Distinct n-grams of the script's characters; a shorter text is its own."""
    key = script_key(text, script)
    return F.when(F.length(key) == 0, F.array().cast("array<string>")).when(F.length(key) < n, F.array(key)).otherwise(F.array_distinct(grams(key, n)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def problems(text: Column | str) -> Column:
    """Which kinds of content make a document unfit, in a fixed order."""
    t = _c(text)
    tests = {"url": F.rlike(t, F.lit(URL)), "email": F.rlike(t, F.lit(EMAIL)), "markup_or_code": F.rlike(t, F.lit(MARKUP)) | (F.regexp_count(t, F.lit(CODE)) >= 2), "personal_id": F.rlike(t, F.lit(PERSONAL_ID)), "phone": F.rlike(t, F.lit(PHONE)), "long_number": F.rlike(t, F.lit(LONG_NUMBER))}
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))


def odd_characters(text: Column | str) -> Column:
    """Private-use, control and format characters, phonetic symbols, compatibility forms, kana and pictographs."""
    return F.regexp_extract_all(_c(text), F.lit(r"[\p{Co}\p{Cs}\p{Cf}\x{3100}-\x{312F}\x{31A0}-\x{31BF}\x{F900}-\x{FAFF}\x{2F00}-\x{2FDF}\x{2E80}-\x{2EFF}\x{FF61}-\x{FF9F}\x{1F000}-\x{1FAFF}]|[\p{Cc}&&[^\n\t]]"), F.lit(0))


def family_key(text: Column | str, rules: dict[str, str]) -> Column:
    """Variants (keys) as their canonical characters."""
    return F.translate(_c(text), "".join(rules), "".join(rules.values()))


def odd_labels(text: Column | str) -> Column:
    """What kind each odd character is, in order: its code point, or the block that it is from."""
    within = lambda c, *blocks: F.rlike(c, F.lit(f"^[{''.join(blocks)}]$"))
    point = lambda c: F.concat(F.lit("U+"), F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0{1,4}", ""))
    label = lambda c: F.when(F.rlike(c, F.lit(r"^[\p{Co}\p{Cs}\p{Cf}\p{Cc}]$")), point(c)).when(within(c, r"\x{3100}-\x{312F}", r"\x{31A0}-\x{31BF}"), "bopomofo").when(within(c, r"\x{F900}-\x{FAFF}", r"\x{2F00}-\x{2FDF}", r"\x{2E80}-\x{2EFF}"), "compatibility_or_radical").otherwise("halfwidth_kana_or_emoji")
    return F.transform(odd_characters(text), label)


def wide_script_key(text: Column | str) -> Column:
    """Only Han characters of the composed text, in the class that corpora are compared by."""
    return script_key(composed(text), "han_wide")
