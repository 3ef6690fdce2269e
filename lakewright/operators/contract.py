"""Guard of the column contract: records whose keys differ from the wanted columns are parked with the difference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.functions.barrier import hold
from lakewright.vocab import CRASH_COLUMNS, ENVELOPE_KEYS

CORRUPT, MISMATCH = "CORRUPT_RECORD", "SCHEMA_MISMATCH"


def check(bronze: DataFrame, *, optional: Sequence[str] = (), expected: Sequence[str] = CRASH_COLUMNS) -> DataFrame:
    """Adds keys' differences (expected_only, source_only, sorted) and error_class; NULL class where the contract holds.

    Column names compare with case. Text that is no JSON object, and a payload that is no object, are CORRUPT_RECORD;
    then all wanted columns are missing.
    """
    top = hold(bronze, F.from_json("raw_value", "map<string,string>").alias("_top"))
    nested = F.map_contains_key("_top", F.lit("payload"))
    inner = F.from_json(F.try_element_at("_top", F.lit("payload")), "map<string,string>")
    top = hold(top, F.when(nested, inner).otherwise(F.map_filter("_top", lambda k, _: ~k.isin(*ENVELOPE_KEYS))).alias("_fields"))
    keys = F.coalesce(F.map_keys("_fields"), F.array().cast("array<string>"))
    wanted, needed = F.array(*map(F.lit, expected)), F.array(*(F.lit(c) for c in expected if c not in optional))
    rows = hold(top, F.array_sort(F.array_except(needed, keys)).alias("expected_only"), F.array_sort(F.array_except(keys, wanted)).alias("source_only"))
    differs = (F.size("expected_only") > 0) | (F.size("source_only") > 0)
    kind = F.when(F.col("_fields").isNull(), CORRUPT).when(differs, MISMATCH)
    return rows.withColumn("error_class", kind).drop("_top", "_fields")


def signatures(checked: DataFrame) -> DataFrame:
    """Distinct differences by topic with the number of records."""
    joined = [F.array_join(c, ",").alias(c) for c in ("expected_only", "source_only")]
    bad = checked.where("error_class is not null").select("topic", "error_class", *joined)
    return bad.groupBy("topic", "error_class", "expected_only", "source_only").agg(F.count("*").alias("records"))


def route(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, rows to park) of a checked batch."""
    return checked.where("error_class is null"), checked.where("error_class is not null")
