"""Spark session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results; performance settings are left to the cluster.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_LTZ",
    "spark.sql.ansi.enabled": "true",
}


def get_session(app: str = "lakewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's semantics, adaptive execution and skew handling on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = SEMANTICS | {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where that is unset on a local master, as in tests, a folder of this machine stands in; a cluster without it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"lakewright-{os.getuid()}")
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    Cuts lineage so that a lost executor costs a re-read instead of a recomputation, and lets two consumers
    share one expensive pass. The files belong to the run; ``spark.checkpoint.dir`` is the place the cluster clears.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; looks at ``limit + 1`` rows at most."""
    return df.limit(limit + 1).count() <= limit
