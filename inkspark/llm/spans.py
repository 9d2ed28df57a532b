"""Spans of pattern matches in code points, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,match:string,part:string>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """SPAN of the leftmost non-overlapping matches of `pattern`; part: what `group` took.

    The text between matches has the lengths that place them: the same pattern cuts it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(found, parts, lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    each = F.zip_with(F.slice(gaps, 1, F.size(found)), both, lambda g, b: F.struct(F.length(g).cast("long").alias("gap"), b["m"].alias("m"), b["p"].alias("p")))
    start = F.array().cast(SPAN)
    last = lambda a: F.when(F.size(a) > 0, F.get(a, F.size(a) - 1)["end"]).otherwise(F.lit(0).cast("long"))
    add = lambda a, x: F.concat(a, F.array(F.struct((last(a) + x["gap"]).alias("start"), (last(a) + x["gap"] + F.length(x["m"])).cast("long").alias("end"), x["m"].alias("match"), x["p"].alias("part"))))
    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(each, start, add)).otherwise(start)


def named(spans: Column, kind: str, order: int) -> Column:
    """The spans as (order, kind, start, end)."""
    return F.transform(spans, lambda s: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def counted(spans: Column, kind: str) -> Column:
    """How many spans are of the kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def joined(spans: Column, *by: str) -> Column:
    """kind:start:end of spans (as from `named`) by the given fields, comma-joined."""
    keyed = F.transform(spans, lambda s: F.struct(*(s[b].alias(f"_{b}") for b in by), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def rewritten(text: Column, spans: Column, to: str = "to") -> Column:
    """`text` with each of the sorted, non-overlapping spans (start, end, `to`) put in place of what it covers."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), s[to]).alias("out"), s["end"].alias("at"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
