"""Known faults put into clean data, to measure what the engine makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of faults.
KINDS = ("typo", "swap", "double", "unknown", "missing", "cut")


def pick(key: Column, n: int, seed: str = "0") -> Column:
    """A number below n that only key and seed determine."""
    return F.pmod(F.crc32(F.concat(key.cast("string"), F.lit(seed))), F.lit(n)).cast("int")


def corrupt(value: Column, kind: Column, key: Column) -> Column:
    """The value with one fault; a place after the first letter is hit."""
    at = pick(key, 1_000_003) % F.greatest(F.length(value) - 1, F.lit(1)) + 2
    head, letter, tail = F.substring(value, 1, at - 1), F.substring(value, at, F.lit(1)), F.substring(value, at + 1, F.length(value))
    return (
        F.when(kind == "typo", F.concat(head, tail)).when(kind == "swap", F.concat(head, F.substring(tail, 1, 1), letter, F.substring(tail, F.lit(2), F.length(value))))
        .when(kind == "double", F.concat(head, letter, letter, tail)).when(kind == "unknown", F.concat(F.lit("ZZ "), F.reverse(value)))
        .when(kind == "missing", F.lit(None).cast("string")).when(kind == "cut", F.substring(value, F.lit(1), F.greatest(F.floor(F.length(value) / 2).cast("int"), F.lit(1))))
        .otherwise(value)
    )


def inject(rows: DataFrame, column: str, key: str = "record_id", every: int = 10, seed: str = "0") -> DataFrame:
    """Adds fault (kind or NULL) and before; one key in ``every`` gets a fault in ``column``."""
    number = pick(F.col(key), every * len(KINDS), seed)
    kinds = F.array(*map(F.lit, KINDS))
    hit = (number % every == 0) & F.col(column).isNotNull() & (F.length(column) > 1)
    fault = F.when(hit, F.try_element_at(kinds, (F.floor(number / every) + 1).cast("int")))
    marked = rows.withColumn("fault", fault).withColumn("before", F.col(column))
    return marked.withColumn(column, F.when(F.col("fault").isNotNull(), corrupt(F.col(column), F.col("fault"), F.col(key))).otherwise(F.col(column)))


def outcomes(standardized: DataFrame, column: str) -> DataFrame:
    """(fault, outcome, records): FIXED, WRONG_FIX, QUARANTINED, EMPTY or CLEAN, against what was there before."""
    caught = F.map_contains_key("columns_to_remediate", F.lit(column))
    outcome = (
        F.when(F.col("fault").isNull(), "CLEAN").when(caught, "QUARANTINED").when(F.col(column).isNull(), "EMPTY")
        .when(F.col(column) == F.upper(F.trim("before")), "FIXED").otherwise("WRONG_FIX")
    )
    return standardized.groupBy(F.coalesce("fault", F.lit("none")).alias("fault"), outcome.alias("outcome")).agg(F.count("*").alias("records"))
