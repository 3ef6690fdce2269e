"""Reported failures in one form: type families, signatures, identities, grouping and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Families of failure types, and another name of one.
FAMILIES = {
    "SCHEMA": ("SCHEMA_MISMATCH", "SCHEMA_DRIFT", "MISSING_COLUMN"), "RECORD": ("CORRUPT_RECORD",),
    "VALUE": ("UNRESOLVED_VALUE", "AMBIGUOUS_VALUE", "TYPE_MISMATCH", "PARSE_ERROR"),
}
ALIASES = {"SCHEMA_MISMATCH": "SCHEMA_DRIFT"}
SAMPLES = 5


def canonical_type(kind: Column) -> Column:
    """Type in the shared vocabulary, upper case and trimmed."""
    name = F.upper(F.trim(kind))
    return F.coalesce(*(F.when(name == old, F.lit(new)) for old, new in ALIASES.items()), name)


def family(kind: Column) -> Column:
    """SCHEMA, RECORD, VALUE or UNKNOWN."""
    name = F.upper(kind)
    return F.coalesce(*(F.when(name.isin(*kinds), F.lit(f)) for f, kinds in FAMILIES.items()), F.lit("UNKNOWN"))


def split_table(name: Column) -> tuple[Column, Column]:
    """(layer, source) of a per-source table such as silver2_crash3; both NULL for any other."""
    last = F.element_at(F.split(F.regexp_replace(F.trim(name), "/+$", ""), "/"), -1)
    fits = last.rlike("^(bronze|silver1|silver2)_[^_]+$") & ~last.endswith("_quarantine")
    return F.when(fits, F.split_part(last, F.lit("_"), F.lit(1))), F.when(fits, F.split_part(last, F.lit("_"), F.lit(2)))


def schema_value(expected_only: Column, source_only: Column) -> Column:
    """Stable text of a difference of column sets."""
    joined = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    return F.concat(F.lit("EXPECTED_ONLY="), joined(expected_only), F.lit(";SOURCE_ONLY="), joined(source_only))


def parse_schema_value(value: Column) -> tuple[Column, Column]:
    """The two column lists of schema_value()."""
    names = lambda key: F.filter(F.transform(F.split(F.regexp_extract(value, f"{key}=([^;]*)", 1), ","), F.trim), lambda x: x != "")
    return names("EXPECTED_ONLY"), names("SOURCE_ONLY")


def signature_value() -> Column:
    """What a failure is about: its difference of columns, or its raw value."""
    return F.when(family(F.col("failure_type")) == "SCHEMA", schema_value(F.col("expected_only"), F.col("source_only"))).otherwise(F.coalesce("raw_value", F.lit("")))


def with_signature(failures: DataFrame) -> DataFrame:
    """Adds signature_key (layer|column|VALUE) and identity (32 hex digits of a hash, equal for repeated reports)."""
    signature = F.concat_ws("|", F.coalesce("detected_layer", F.lit("")), F.coalesce("column_name", F.lit("")), F.upper(F.trim(signature_value())))
    identity = F.substring(F.sha2(F.concat_ws("|", F.coalesce("folder", F.lit("")), F.coalesce("batch_id", F.lit("")), canonical_type(F.col("failure_type")), signature), 256), 1, 32)
    return failures.withColumn("signature_key", signature).withColumn("identity", identity)


def delivered_once(failures: DataFrame) -> DataFrame:
    """One report per failure_id: the least of its copies, found by a partial minimum."""
    rest = [c for c in failures.columns if c != "failure_id"]
    kept = failures.groupBy("failure_id").agg(F.min(F.struct(*rest)).alias("_r"))
    return kept.select("failure_id", "_r.*").select(*failures.columns)


def least(rows: DataFrame, by: list[str], value: str, k: int, name: str) -> DataFrame:
    """(by..., name): the k least distinct values of each group, in order. Ranked with a limit before the shuffle."""
    distinct = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")).distinct()
    ranked = distinct.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_v"))).where(F.col("_n") <= k)
    return ranked.groupBy(*by).agg(F.array_sort(F.collect_list("_v")).alias(name))


def merged(failures: DataFrame) -> DataFrame:
    """Failures of one folder and signature as one: rows summed (NULL if all are), batches united, least samples, trusted if all are."""
    rows, keys = with_signature(delivered_once(failures)), ["folder", "signature_key"]
    own = F.slice(F.array_sort(F.coalesce("sample_record_ids", F.array().cast("array<string>"))), 1, SAMPLES)
    samples = least(rows.select(*keys, F.explode(own).alias("id")), keys, "id", SAMPLES, "samples")
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("reports"), F.sum("rows_affected").alias("rows_affected"), F.array_sort(F.collect_set("batch_id")).alias("batches"),
        F.bool_and("trusted").alias("trusted"), F.max("mandatory").alias("mandatory"), F.max("failure_type").alias("failure_type"),
    )
    return _null_safe(sums, samples, keys).withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which NULL keys are equal."""
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    rest = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), on, "left").select("l.*", *rest)


def from_quarantine(quarantined: DataFrame, *, folder: str = "table_name", batch: str = "batch_id", mandatory: tuple[str, ...] = ("crash_date",), every_id: bool = False) -> DataFrame:
    """Failures of quarantined rows by folder, column and value. Samples are the least of the batches' least record ids, or, with ``every_id``, the least of all record ids."""
    keys = ["folder", "column_name", "raw_value"]
    long = quarantined.select(F.col(folder).alias("folder"), F.col(batch).alias("batch"), "record_id", F.explode("columns_to_remediate").alias("column_name", "value"))
    first = long.groupBy("folder", "column_name", F.upper(F.trim("value")).alias("raw_value"), "batch").agg(F.count("*").alias("n"), F.min("record_id").alias("sample"))
    sums = first.groupBy(*keys).agg(F.sum("n").alias("rows_affected"), F.count("*").alias("batches"), F.max(F.col("column_name").isin(*mandatory)).alias("mandatory"))
    if every_id:
        first = long.select("folder", "column_name", F.upper(F.trim("value")).alias("raw_value"), F.col("record_id").alias("sample"))
    return _null_safe(sums, least(first, keys, "sample", SAMPLES, "samples"), keys).select(*keys, "rows_affected", "batches", "samples", "mandatory")
