"""Secret scans (operator 6): an incremental blob ledger, in DataFrame functions only.

Every version of a file is known by its content's SHA-256. A scan takes each content once, evaluates on it only the
rules whose pair of content and rule version the ledger lacks, and joins the findings back to every path and version
that has the content. The ledger is a table (blob, rule, version, spans) that only grows; a rule's new version is
scanned anew and older versions' rows stay.

Defined cases: a null text is the empty content; repeated rows get equal results; rows with a null path are scanned
too; contents of any length are scanned whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.llm.spans import counted, joined, matches
from inkspark.sources.shared import written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    version: int = 1
    group: int = 0  # the secret's own part, whose length must be at least:
    length: int = 0
    base: bool = False


#: The kinds in the order of reports. A run of one class has one match, so its least length stands in
#: the pattern; `assign` is matched first and measured afterwards, as a short value still uses up its text.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=\-]+)""", group=2, length=8, base=True),
    Rule("access", r"AKIA[A-Z0-9]{12,}+", base=True),
    Rule("hex", r"[0-9a-f]{32,}+", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_\-]{8,}+\.eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+"),
    Rule("host_token", r"gh[opsur]_[A-Za-z0-9]{36,}+"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9\-]{10,}+"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_\-]{35}"),
)
LEDGER = "blob string, rule string, version int, spans array<struct<start:bigint,end:bigint>>"


def _scan(text: Column, rule: Rule) -> Column:
    found = matches(text, rule.pattern, rule.group)
    if rule.length:
        found = F.filter(found, lambda s: F.length(s["part"]) >= rule.length)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows: findings of the pairs of content and rule version that `ledger` lacks (no spans: clean).

    Which rows to read is settled on hashes; the texts then meet only the blobs with something to do.
    """
    keyed = versions.select(blob_of(F.col(text)).alias("blob"), F.xxhash64(*(F.col(f"`{c}`") for c in versions.columns if c != text and not versions.schema[c].dataType.simpleString().startswith("map"))).alias("row"), F.coalesce(text, F.lit("")).alias("content"))
    once = keyed.groupBy("blob").agg(F.min("row").alias("row"))
    every = F.array(*(F.lit(i) for i in range(len(rules))))
    if ledger is None:
        todo = once.withColumn("todo", every)
    else:
        number = F.coalesce(*(F.when((F.col("rule") == r.kind) & (F.col("version") == r.version), F.lit(i)) for i, r in enumerate(rules)))
        done = ledger.select("blob", number.alias("i")).filter("i is not null").groupBy("blob").agg(F.collect_set("i").alias("done"))
        todo = once.join(done, "blob", "left").select("blob", "row", F.array_except(every, F.coalesce("done", F.array().cast("array<int>"))).alias("todo")).filter(F.size("todo") > 0)
    todo = written(todo, "ledger-todo")
    met = keyed.join(todo.hint("shuffle_hash"), ["blob", "row"])
    each = F.array(*(F.when(F.array_contains("todo", i), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), _scan(F.col("content"), r).alias("spans"))) for i, r in enumerate(rules)))
    found = met.select("blob", F.explode(F.array_compact(each)).alias("f")).select("blob", "f.*")
    # A row that stands twice, equal in all columns, was read twice.
    return found.groupBy("blob", "rule", "version").agg(F.first("spans").alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, blob and spans (order, kind, start, end) of every row of `versions`, from the ledger."""
    now = F.array(*(F.concat_ws("@", F.lit(r.kind), F.lit(r.version)) for r in rules))
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    hits = ledger.filter((F.size("spans") > 0) & F.array_contains(now, F.concat_ws("@", "rule", "version")))
    one = hits.select("blob", F.transform("spans", lambda s: F.struct(order[F.col("rule")].alias("order"), F.col("rule").alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    by_blob = one.groupBy("blob").agg(F.flatten(F.collect_set("spans")).alias("__spans"))
    paths = versions.select(*keep, blob_of(F.col(text)).alias("blob"))
    return paths.join(by_blob, "blob", "left").select(*keep, "blob", F.coalesce("__spans", F.array().cast("array<struct<order:int,kind:string,start:bigint,end:bigint>>")).alias("spans"))


def scanned(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(findings of every row, the ledger's new rows)."""
    new = written(scan(versions, ledger, rules, text), "ledger")
    return findings(versions, new if ledger is None else ledger.unionByName(new), rules, text, keep), new


def digests(found: DataFrame) -> DataFrame:
    base = [r.kind for r in RULES if r.base]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [counted(F.col("spans"), k) for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(own, "start", "order"), 256).alias("base_sha256"), joined(F.col("spans"), "start", "order").alias("spans"))
