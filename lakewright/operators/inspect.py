"""Looking at tables: previews, lookups by id, traces of a record over the layers, differences, overviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def peek(df: DataFrame, *, where: str | None = None, columns: Sequence[str] | None = None, order: Sequence[str] = (), limit: int = 20) -> DataFrame:
    """The first rows; order columns that the table lacks are passed over."""
    rows = df.where(where) if where else df
    there = [c for c in order if c in rows.columns]
    rows = rows.orderBy(*there) if there else rows
    return (rows.select(*columns) if columns else rows).limit(limit)


def by_id(df: DataFrame, text: str, columns: Sequence[str] = ("record_id", "crash_record_id")) -> DataFrame:
    """Rows of which an id is the text or begins with it."""
    hit = F.lit(False)
    for c in columns:
        if c in df.columns:
            hit = hit | F.coalesce(F.col(c).startswith(text), F.lit(False))
    return df.where(hit)


def neighbour(df: DataFrame, column: str, value: str, *, after: bool = True) -> DataFrame:
    """The next (or previous) row in the order of a column."""
    rows = df.where(F.col(column) > value).orderBy(column) if after else df.where(F.col(column) < value).orderBy(F.col(column).desc())
    return rows.limit(1)


def sample(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows with distinct keys in an order that only seed and key determine."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key]).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def mentions(texts: DataFrame, text: str, ids: DataFrame, id_column: str) -> DataFrame:
    """(id, texts): how many texts mention each id. Ids are cut out of the texts and joined by equality, not searched one by one."""
    said = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({UUID})"), 1))).alias("id"))
    counted = said.groupBy("id").agg(F.count("*").alias("texts"))
    return counted.join(ids.select(F.col(id_column).alias("id")).distinct(), "id", "left_semi")


def trace(layers: dict[str, DataFrame], key: str = "record_id") -> DataFrame:
    """(key, rows in each layer). Layers are counted before they meet, so no key meets with itself."""
    parts = [df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(name).alias("layer"), "n") for name, df in layers.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col("layer") == name, F.col("n"))), F.lit(0)).alias(name) for name in layers))


def differences(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column_name, before, after) of values that differ as trimmed text; keys should be unique on both sides."""
    text = lambda c: F.trim(c.cast("string"))
    joined = before.alias("b").join(after.alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), text(F.col(f"b.{c}")).alias("before"), text(F.col(f"a.{c}")).alias("after")) for c in columns))
    return joined.select(F.col(f"b.{key}").alias(key), F.inline(pairs)).where("not (before <=> after)")


def first_arrivals(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the least in ``order``; rows without key are left out."""
    rest = [c for c in df.columns if c != key and c not in order]
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return least.select(*(F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns))


def layer_changes(layers: dict[str, DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column_name, value in each layer): columns of a record with more than one value over the layers.

    Values compare as trimmed text; blank ones and columns that a layer lacks don't count as values. Keys should be unique in each layer.
    """
    text = lambda df, c: F.trim(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string")
    parts = [df.where(F.col(key).isNotNull()).select(key, F.lit(name).alias("_layer"), F.struct(*(text(df, c).alias(c) for c in columns)).alias("_v")) for name, df in layers.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    rows = union.groupBy(key).agg(*(F.min(F.when(F.col("_layer") == name, F.col("_v"))).alias(name) for name in layers))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{name}.{c}").alias(name) for name in layers)) for c in columns))
    values = F.array(*(F.nullif(F.col(name), F.lit("")) for name in layers))
    return rows.select(key, F.inline(pairs)).where(F.size(F.array_distinct(F.array_compact(values))) > 1)


def rate(part: Column, whole: Column) -> Column:
    """Share with four decimals; NULL of nothing."""
    return F.round(F.try_divide(part, whole), 4)


def spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, median, p90 by nearest rank, max and mean (one decimal) of a value per group, without gathering a group in one place.

    Equal values are counted first; ranks are running sums over the distinct values.
    """
    from pyspark.sql import Window

    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    upto, all_ = Window.partitionBy(*by).orderBy("v"), Window.partitionBy(*by)
    ranked = counted.withColumn("u", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(all_))
    at = lambda rank: F.min(F.when(F.col("u") > rank, F.col("v")))
    low, high = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))
    return ranked.groupBy(*by).agg(
        F.max("n").alias("n"), F.round((low + high) / 2, 1).alias("median"), F.round(at(F.bround(F.lit(0.9) * (F.col("n") - 1), 0)), 1).alias("p90"),
        F.round(F.max("v"), 1).alias("max"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 1).alias("mean"),
    )


def sql_over(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """SQL over DataFrames given by name as ``{name}``; no view outlives it, so that concurrent batches don't see each other's."""
    return spark.sql(text, **frames)


def backfill(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Columns that are NULL or missing take a derived value; what is there stays."""
    return rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in values.items()})
