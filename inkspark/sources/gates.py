"""Licence gates over source registries, as columns: what stands against a source. What is not known refuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a permission may say, fields that must be filled, and those of the everyday registry.
PERMISSIONS = ("allowed", "allowed_with_attribution", "allowed_under_general_grant", "not_allowed")
PERMITTED = ("commercial_use", "modification", "redistribution", "ai_training")
FILLED = ("license", "license_url", "attribution", "downloaded_at", "sha256", "official_dataset_url")
DETERMINED = ("dataset_name", "provider", "official_page", "version", "retrieved_at", "license_name", "license_url", "redistribution", "attribution", "data_type", "zh_tw_relevance", "document_identity", "reason")
REQUIRED_YES = ("commercial_use", "modification", "training_use")
SCOPES = {"production": ("production",), "dev_experiment": ("production", "dev_experiment")}
CHARACTERS = "character_table"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def issues() -> Column:
    """Why a registered source may not enter the corpus: status, each permission, the ground of a general grant, each
    field to be filled, and the allowed uses."""
    found = [F.when(_text("status") != "approved", F.concat(F.lit("status="), _text("status")))]
    for name in PERMITTED:
        found.append(F.when(~_text(name).isin(*PERMISSIONS), F.lit(f"{name} unknown")).when(_text(name) == "not_allowed", F.lit(f"{name} not allowed")))
    found.append(F.when((_text("ai_training") == "allowed_under_general_grant") & (_text("ai_training_basis") == ""), F.lit("ai_training_basis missing")))
    found += [F.when(_text(name) == "", F.lit(f"{name} missing")) for name in FILLED]
    uses = F.coalesce("allowed_uses", F.array().cast("array<string>"))
    found.append(F.when(~F.array_contains(uses, "corpus") & (_text("kind") != CHARACTERS), F.lit("allowed_uses without corpus")))
    return F.array_compact(F.array(*found))


def everyday_issues(purpose: str = "dev_experiment") -> Column:
    """Why an everyday source may not be imported for a purpose: every field settled, every right granted, a digest for
    every file."""
    files = F.coalesce("files", F.array().cast("array<struct<path:string,url:string,sha256:string,bytes:bigint>>"))
    found = [F.when(_text("status") != "APPROVED", F.concat(F.lit("status "), _text("status")))]
    found.append(F.when(~_text("approval_scope").isin(*SCOPES[purpose]), F.concat(F.lit("approval_scope "), _text("approval_scope"), F.lit(f" not for {purpose}"))))
    found += [F.when((F.trim(_text(n)) == "") | F.lower(F.trim(_text(n))).startswith("unknown"), F.lit(f"{n} not settled")) for n in DETERMINED]
    found += [F.when(~_text(n).startswith("yes"), F.concat(F.lit(f"{n} = "), _text(n))) for n in REQUIRED_YES]
    found.append(F.when(~_text("training_basis").isin("explicit", "inferred"), F.lit("training_basis not settled")).when((_text("training_basis") == "inferred") & (F.trim(_text("inference_basis")) == ""), F.lit("inference_basis missing")))
    found.append(F.when((F.size(F.coalesce("urls", F.array().cast("array<string>"))) == 0) | (F.size(files) == 0), F.lit("no url or file")))
    digests = F.transform(F.filter(files, lambda f: F.length(F.coalesce(f["sha256"], F.lit(""))) != 64), lambda f: F.concat(F.coalesce(f["path"], F.lit("")), F.lit(" without digest")))
    fields = F.when(F.size(F.coalesce("fields_used", F.array().cast("array<string>"))) == 0, F.lit("fields_used empty"))
    return F.concat(F.array_compact(F.array(*found)), digests, F.array_compact(F.array(fields)))


def registry(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """The `sources` of a registry file as rows; an id that stands twice is an error."""
    rows = spark.read.schema(f"sources array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline("sources"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    checked = rows.join(counts, key)
    once = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("registered twice: "), F.col(key)))).otherwise(F.col(key))
    return checked.withColumn(key, once).select(*rows.columns)


def production(registry: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Sources without an issue, of the given kinds only."""
    fit = registry.filter(F.size(issues()) == 0)
    return fit if kinds is None else fit.filter(F.col("kind").isin(*kinds))


def production_ids(registry: DataFrame) -> DataFrame:
    """source_id of everyday sources that are approved for production."""
    return registry.filter(F.size(everyday_issues("production")) == 0).select("source_id")


def required(registry: DataFrame, found: Column, key: str = "source_id") -> DataFrame:
    """`registry`, an error as soon as a source with an issue is read."""
    stop = F.raise_error(F.concat_ws("; ", F.concat(F.col(key), F.lit(":")), found))
    return registry.withColumn(key, F.when(F.size(found) > 0, stop).otherwise(F.col(key)))


def available(candidates: DataFrame, allowed: list[str], model_sources: list[str] | None = None) -> DataFrame:
    """Candidates that need nothing beyond the allowed sources, and whose model sources are exactly those given."""
    fit = candidates.filter(F.size(F.array_except("sources", F.array(*map(F.lit, allowed)).cast("array<string>"))) == 0)
    if model_sources is not None:
        fit = fit.filter(F.sort_array("lm_sources") == F.array(*map(F.lit, sorted(model_sources))).cast("array<string>"))
    return fit
