"""Phonetic syllables, readings and keyboards as column expressions and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The phonetic symbols by kind, and tone marks (no mark and the first one are tone 1).
INITIALS, MEDIALS, FINALS = "ㄅㄆㄇㄈㄉㄊㄋㄌㄍㄎㄏㄐㄑㄒㄓㄔㄕㄖㄗㄘㄙ", "ㄧㄨㄩ", "ㄚㄛㄜㄝㄞㄟㄠㄡㄢㄣㄤㄥㄦ"
MARKS = "ˉˊˇˋ˙"
SYLLABLE = f"^(˙?)([{INITIALS}]?)([{MEDIALS}]?)([{FINALS}]?)([{MARKS}]?)$"
#: The standard layout's keys in the order of INITIALS + MEDIALS + FINALS; tones; staggered rows.
SYMBOL_KEYS = "1qaz2wsxedcrfv5tgbyhnujm8ik,9ol.0p;/-"
TONE_KEYS = {" ": "", "6": "ˊ", "3": "ˇ", "4": "ˋ", "7": "˙"}
ROWS = ("1234567890-", "qwertyuiop", "asdfghjkl;", "zxcvbnm,./")


def syllable(text: Column | str) -> Column:
    """(initial, medial, final, tone) with nulls for absent parts; null where it is no syllable."""
    raw = F.trim(F.col(text) if isinstance(text, str) else text)
    part = lambda i: F.regexp_extract(raw, SYLLABLE, i)
    some = lambda i: F.when(part(i) != "", part(i))
    tone = F.when((part(1) != "") | (part(5) == "˙"), 5).when(part(5) == "ˊ", 2).when(part(5) == "ˇ", 3).when(part(5) == "ˋ", 4).otherwise(1)
    valid = F.rlike(raw, F.lit(SYLLABLE)) & (F.concat(part(2), part(3), part(4)) != "") & ~((part(1) != "") & (part(5) != ""))
    return F.when(valid, F.struct(some(2).alias("initial"), some(3).alias("medial"), some(4).alias("final"), tone.alias("tone")))


def canonical(text: Column | str) -> Column:
    """A syllable in its usual writing: the mark last, none for tone 1."""
    s = syllable(text)
    mark = F.element_at(F.create_map(*(F.lit(x) for p in zip(range(1, 6), ("", "ˊ", "ˇ", "ˋ", "˙"), strict=True) for x in p)), s["tone"])
    return F.when(s.isNotNull(), F.concat(F.coalesce(s["initial"], F.lit("")), F.coalesce(s["medial"], F.lit("")), F.coalesce(s["final"], F.lit("")), mark))


def reading(text: Column | str) -> Column:
    """The syllables of a reading: a mark, a space, a tab or a hyphen ends one; null where any is none."""
    raw = F.col(text) if isinstance(text, str) else text
    body = f"[{INITIALS}{MEDIALS}{FINALS}]"
    parts = F.transform(F.regexp_extract_all(raw, F.lit(f"{body}+[{MARKS}]?"), F.lit(0)), canonical)
    whole = F.rlike(raw, F.lit(rf"^[ \t-]*(?:{body}+[{MARKS}]?[ \t-]*)+$"))
    return F.when(whole & F.forall(parts, lambda p: p.isNotNull()), parts)


def tone_variants(text: Column | str) -> Column:
    """Neutral for a toned syllable, the four tones for a neutral one."""
    c = F.col(text) if isinstance(text, str) else text
    body = F.regexp_replace(c, f"[{MARKS}]$", "")
    return F.when(c.endswith("˙"), F.transform(F.array(*map(F.lit, ("", "ˊ", "ˇ", "ˋ"))), lambda m: F.concat(body, m))).otherwise(F.array(F.concat(body, F.lit("˙"))))


def typed(keys: Column | str) -> Column:
    """The syllables that keystrokes give: a later symbol of a kind takes the earlier one's place, a tone key ends the
    syllable, and a space where none is open is skipped; null for keys without meaning or an end without tone."""
    raw = F.lower(F.col(keys) if isinstance(keys, str) else keys)
    symbols = INITIALS + MEDIALS + FINALS
    none = F.struct(F.array().cast("array<string>").alias("out"), *(F.lit("").alias(k) for k in "imf"), F.lit(True).alias("ok"))

    def press(s: Column, key: Column) -> Column:
        at = F.instr(F.lit(SYMBOL_KEYS), key)
        symbol = F.substring(F.lit(symbols), at, F.lit(1))
        kind = F.when(at == 0, "").when(at <= len(INITIALS), "i").when(at <= len(INITIALS) + len(MEDIALS), "m").otherwise("f")
        tone = F.element_at(F.create_map(*(F.lit(x) for p in TONE_KEYS.items() for x in p)), key)
        body = F.concat(s["i"], s["m"], s["f"])
        ends = tone.isNotNull()
        done = ends & (body != "")
        return F.struct(F.when(done, F.concat(s["out"], F.array(F.concat(body, tone)))).otherwise(s["out"]).alias("out"), *(F.when(ends, "").when(kind == k, symbol).otherwise(s[k]).alias(k) for k in "imf"), (s["ok"] & ((kind != "") | done | ((key == " ") & (body == "")))).alias("ok"))

    return F.aggregate(F.filter(F.split(raw, ""), lambda k: k != ""), none, press, lambda s: F.when(s["ok"] & (F.concat(s["i"], s["m"], s["f"]) == ""), s["out"]))


def keyboard(spark: SparkSession) -> DataFrame:
    """key, symbol, kind, neighbours: the keys beside it, above it (c, c+1) and below it (c-1, c)."""
    at = {k: (r, c) for r, row in enumerate(ROWS) for c, k in enumerate(row)}
    symbols = dict(zip(SYMBOL_KEYS, INITIALS + MEDIALS + FINALS, strict=True))
    kind = lambda s: "initial" if s in INITIALS else "medial" if s in MEDIALS else "final"
    near = lambda r, c: [k for dr, dc in ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0)) for k, p in at.items() if p == (r + dr, c + dc)]
    rows = [(k, symbols.get(k), kind(symbols[k]) if k in symbols else None, near(*p)) for k, p in at.items()]
    return spark.createDataFrame(rows, "key string, symbol string, kind string, neighbours array<string>")


def symbol_kind(symbol: Column | str) -> Column:
    """initial, medial or final; null for what is none."""
    c = F.col(symbol) if isinstance(symbol, str) else symbol
    at = F.when(F.length(c) == 1, F.instr(F.lit(INITIALS + MEDIALS + FINALS), c)).otherwise(0)
    return F.when(at == 0, F.lit(None).cast("string")).when(at <= len(INITIALS), "initial").when(at <= len(INITIALS + MEDIALS), "medial").otherwise("final")


def tone_of(mark: Column | str) -> Column:
    """1 to 5 of a tone mark, no mark being tone 1; null for what is none."""
    c = F.col(mark) if isinstance(mark, str) else mark
    return F.when(c == "", 1).when(F.length(c) == 1, F.nullif(F.instr(F.lit(MARKS), c), F.lit(0)))


#: Keys of the composer beside the layout's: they take a symbol back, and all of them.
BACKSPACE, CLEAR = "\b", "\x1b"


def composed(keys: Column | str, inventory: list[str] | None = None) -> Column:
    """(done, initial, medial, final, rejected): syllables composed key by key, what is still open, and how many keys
    were refused. A symbol takes the place of one of its kind; backspace takes back final, medial and initial in turn;
    a tone without symbols, or one that makes no syllable of the inventory, is refused and leaves the open ones."""
    raw = F.lower(F.col(keys) if isinstance(keys, str) else keys)
    none = F.struct(F.array().cast("array<string>").alias("done"), *(F.lit("").alias(k) for k in ("initial", "medial", "final")), F.lit(0).alias("rejected"))
    symbols = INITIALS + MEDIALS + FINALS

    def press(s: Column, key: Column) -> Column:
        at = F.instr(F.lit(SYMBOL_KEYS), key)
        symbol = F.substring(F.lit(symbols), at, F.lit(1))
        kind = F.when(at == 0, "").when(at <= len(INITIALS), "initial").when(at <= len(INITIALS) + len(MEDIALS), "medial").otherwise("final")
        tone = F.element_at(F.create_map(*(F.lit(x) for p in TONE_KEYS.items() for x in p)), key)
        body = F.concat(s["initial"], s["medial"], s["final"])
        known = F.lit(True) if inventory is None else F.array_contains(F.array(*map(F.lit, inventory)), F.concat(body, tone))
        ends = tone.isNotNull() & (body != "") & known
        back, clear = key == BACKSPACE, key == CLEAR
        taken = F.when(s["final"] != "", "final").when(s["medial"] != "", "medial").when(s["initial"] != "", "initial").otherwise("")
        slot = lambda k: F.when(ends | clear | (back & (taken == k)), "").when(kind == k, symbol).otherwise(s[k]).alias(k)
        refused = ~(ends | back | clear | (kind != ""))
        return F.struct(F.when(ends, F.concat(s["done"], F.array(F.concat(body, tone)))).otherwise(s["done"]).alias("done"), *(slot(k) for k in ("initial", "medial", "final")), (s["rejected"] + refused.cast("int")).alias("rejected"))

    return F.aggregate(F.filter(F.split(raw, ""), lambda k: k != ""), none, press)
