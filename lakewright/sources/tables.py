"""Loading of the test tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "bronze_crashes", "silver1_crashes", "silver2_crashes", "silver1_dead_letter", "structured_failures",
    "ref_canonical_mappings", "source_profiles", "benchmark_items", "mix_targets",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; zone-less timestamps are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    local = {c for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.select(*(F.col(c).cast("timestamp").alias(c) if c in local else F.col(c) for c in df.columns)) if local else df


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Register the tables as temporary views of the same names."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
