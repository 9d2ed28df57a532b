"""Reading errors: which syllables a typed one may stand for, at what cost, and seeded noise.

Alternatives are one table (observed, inferred, kind, source, cost, rank) for an inventory of syllables, made once and
joined wherever readings are corrected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions import phonetics as ph

#: Sounds that speakers confuse, and costs (log10) of each kind of error.
CONFUSIONS = (("ㄓ", "ㄗ"), ("ㄔ", "ㄘ"), ("ㄕ", "ㄙ"), ("ㄣ", "ㄥ"), ("ㄢ", "ㄤ"), ("ㄈ", "ㄏ"), ("ㄌ", "ㄋ"), ("ㄖ", "ㄌ"))
COSTS = {"tone_missing": 1.0, "tone_wrong": 1.5, "phonetic_confusion": 1.5, "adjacent_key": 2.0, "insertion": 2.5, "deletion": 2.5, "substitution": 3.0, "transposition": 2.0}
SLOTS = {"initial": ph.INITIALS, "medial": ph.MEDIALS, "final": ph.FINALS}
MARK = ("", "ˊ", "ˇ", "ˋ", "˙")
_OFFER = "array<struct<initial:string,medial:string,final:string,tone:int,kind:string,source:string,cost:double,turn:int>>"


def _slot_of(symbol: str) -> str:
    return next(s for s, symbols in SLOTS.items() if symbol in symbols)


def near_symbols() -> dict[str, list[str]]:
    """The symbols on the keys around each symbol's key."""
    place = {k: (r, c) for r, row in enumerate(ph.ROWS) for c, k in enumerate(row)}
    symbol = dict(zip(ph.SYMBOL_KEYS, ph.INITIALS + ph.MEDIALS + ph.FINALS, strict=True))
    at = {p: symbol[k] for k, p in place.items() if k in symbol}
    return {symbol[k]: [at[q] for d in ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0)) if (q := (r + d[0], c + d[1])) in at] for k, (r, c) in place.items() if k in symbol}


def written_syllable(initial: Column, medial: Column, final: Column, tone: Column) -> Column:
    mark = F.element_at(F.array(*map(F.lit, MARK)), tone)
    return F.concat(F.coalesce(initial, F.lit("")), F.coalesce(medial, F.lit("")), F.coalesce(final, F.lit("")), mark)


def _per_symbol(table: dict[str, list[str]], key: Column) -> Column:
    """The list that a static table has for a symbol; empty for none."""
    flat = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))]
    return F.coalesce(F.try_element_at(F.create_map(*flat), key), F.array().cast("array<string>"))


def _offers(s: Column, costs: dict[str, float]) -> Column:
    """Every syllable one operation away, in the order in which equal costs are settled."""
    def offer(kind: Column | str, source: str, cost: Column | float, turn: int, **changed: Column) -> Column:
        part = {k: changed.get(k, s[k]) for k in ("initial", "medial", "final", "tone")}
        return F.struct(*(part[k].alias(k) for k in part), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(source).alias("source"), (F.lit(cost) if isinstance(cost, float) else cost).alias("cost"), F.lit(turn).alias("turn"))

    none = F.array().cast(_OFFER)
    null = F.lit(None).cast("string")
    first = s["tone"] == 1
    tones = F.transform(F.filter(F.array(*map(F.lit, range(1, 6))), lambda t: t != s["tone"]), lambda t: offer(F.when(first, "tone_missing").otherwise("tone_wrong"), "tone", F.when(first, costs["tone_missing"]).otherwise(costs["tone_wrong"]), 0, tone=t))
    confused: dict[str, list[str]] = {}
    for a, b in CONFUSIONS:
        confused.setdefault(a, []).append(b)
        confused.setdefault(b, []).append(a)
    near, parts = near_symbols(), [tones]
    for i, (slot, symbols) in enumerate(SLOTS.items()):
        now, all_symbols = s[slot], F.array(*map(F.lit, symbols))
        missing = F.transform(all_symbols, lambda x: offer("deletion", "keyboard", costs["deletion"], 10 * i + 1, **{slot: x}))  # noqa: B023
        extra = F.array(offer("insertion", "keyboard", costs["insertion"], 10 * i + 1, **{slot: null}))
        sounds = F.transform(_per_symbol({k: [x for x in v if x in symbols] for k, v in confused.items() if k in symbols}, now), lambda x: offer("phonetic_confusion", "pronunciation", costs["phonetic_confusion"], 10 * i + 2, **{slot: x}))  # noqa: B023
        keys = []
        for other in SLOTS:
            beside = _per_symbol({k: [x for x in v if _slot_of(x) == other] for k, v in near.items() if k in symbols}, now)
            if other == slot:
                keys.append(F.transform(beside, lambda x: offer("adjacent_key", "keyboard", costs["adjacent_key"], 10 * i + 3, **{slot: x})))  # noqa: B023
            else:
                moved = F.transform(beside, lambda x: offer("adjacent_key", "keyboard", costs["adjacent_key"], 10 * i + 3, **{slot: null, other: x}))  # noqa: B023
                keys.append(F.when(s[other].isNull(), moved).otherwise(none))
        changed = F.transform(F.filter(all_symbols, lambda x: x != now), lambda x: offer("substitution", "keyboard", costs["substitution"], 10 * i + 4, **{slot: x}))  # noqa: B023
        parts.append(F.when(now.isNull(), missing).otherwise(F.concat(extra, sounds, *keys, changed)))
    return F.concat(*parts)


def alternatives(observed: DataFrame, inventory: DataFrame, costs: dict[str, float] = COSTS) -> DataFrame:
    """observed, inferred, kind, source, cost, rank (from 1, by cost and then reading) of the inventory's syllables one
    operation away from each distinct `observed`; of several ways to one the cheapest counts, then the first offered."""
    from pyspark.sql.window import Window

    each = observed.select("observed").distinct().withColumn("s", ph.syllable("observed")).filter("s is not null").select("observed", F.explode(_offers(F.col("s"), costs)).alias("o"))
    body = F.coalesce("o.initial", "o.medial", "o.final").isNotNull()
    named = each.filter(body).select("observed", written_syllable(F.col("o.initial"), F.col("o.medial"), F.col("o.final"), F.col("o.tone")).alias("inferred"), "o.kind", "o.source", "o.cost", "o.turn").filter("inferred <> observed")
    known = named.join(F.broadcast(inventory.select(F.col("syllable").alias("inferred")).distinct()), "inferred", "left_semi")
    best = known.groupBy("observed", "inferred").agg(F.min_by(F.struct("kind", "source", "cost"), F.struct("cost", "turn")).alias("b")).select("observed", "inferred", "b.*")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("observed").orderBy("cost", "inferred")))


def noisy(cases: DataFrame, inventory: DataFrame, kinds: tuple[str, ...] = ("tone_missing", "tone_wrong", "adjacent_key", "substitution", "deletion", "insertion")) -> DataFrame:
    """case_id, kind, position, reading, readings: one error of each kind in each case (case_id, readings).

    The place and the syllable are those of the least SHA-256 of case, kind, place and syllable: a hash in place of a
    seeded generator, so any task gives the same. Cases where a kind gives no syllable of the inventory have no row.
    What is put in here is what `alternatives` would take out: a missing tone mark leaves tone 1, an insertion fills an
    empty slot, a deletion empties one.
    """
    each = cases.select("case_id", F.posexplode("readings").alias("position", "observed"))
    s = ph.syllable("observed")
    part = lambda c, **k: written_syllable(*(k.get(x, c[x]) for x in ("initial", "medial", "final", "tone")))
    row = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("reading"))
    made, near = [], near_symbols()
    c = F.col("s")
    made.append(F.when(c["tone"] != 1, F.array(row("tone_missing", part(c, tone=F.lit(1))))))
    made.append(F.transform(F.filter(F.array(*map(F.lit, range(2, 6))), lambda t: t != c["tone"]), lambda t: row("tone_wrong", part(c, tone=t))))
    for slot, symbols in SLOTS.items():
        now, every = c[slot], F.array(*map(F.lit, symbols))
        beside = _per_symbol({k: [x for x in v if x in symbols] for k, v in near.items() if k in symbols}, now)
        made.append(F.when(now.isNull(), F.transform(every, lambda x: row("insertion", part(c, **{slot: x})))))  # noqa: B023
        made.append(F.when(now.isNotNull(), F.array(row("deletion", part(c, **{slot: F.lit(None).cast("string")})))))
        made.append(F.when(now.isNotNull(), F.transform(F.filter(every, lambda x: x != now), lambda x: row("substitution", part(c, **{slot: x})))))  # noqa: B023
        made.append(F.when(now.isNotNull(), F.transform(beside, lambda x: row("adjacent_key", part(c, **{slot: x})))))  # noqa: B023
    none = F.array().cast("array<struct<kind:string,reading:string>>")
    options = each.withColumn("s", s).filter("s is not null").select("case_id", "position", "observed", F.explode(F.concat(*(F.coalesce(m, none) for m in made))).alias("x")).select("case_id", "position", "observed", "x.*")
    fit = options.filter(F.col("kind").isin(*kinds) & (F.col("reading") != F.col("observed"))).join(F.broadcast(inventory.select(F.col("syllable").alias("reading")).distinct()), "reading", "left_semi")
    draw = F.sha2(F.concat_ws("\0", F.col("case_id").cast("string"), "kind", F.col("position").cast("string"), "reading"), 256)
    # A case's readings come back only to its few drawn errors.
    one = fit.groupBy("case_id", "kind").agg(F.min_by(F.struct("position", "reading"), draw).alias("x")).select("case_id", "kind", "x.*")
    whole = cases.select(F.col("case_id").alias("__case"), "readings")
    return one.join(whole, F.col("case_id").eqNullSafe(F.col("__case"))).select("case_id", "kind", "position", "reading", F.transform("readings", lambda r, i: F.when(i == F.col("position"), F.col("reading")).otherwise(r)).alias("readings"))
