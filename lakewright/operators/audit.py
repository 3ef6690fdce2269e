"""Reads of a log of repairs: (execution_id, failure_id, status, executed_at, record_ids, ...), one row per attempt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUCCESS = "SUCCESS"


def attempts(log: DataFrame, *, execution_id: str | None = None, failure_id: str | None = None) -> DataFrame:
    """Attempts of an execution or on a failure, oldest first."""
    rows = log
    for c, value in (("execution_id", execution_id), ("failure_id", failure_id)):
        rows = rows if value is None else rows.where(F.col(c) == value)
    return rows.orderBy("executed_at", "execution_id")


def first_success(log: DataFrame) -> DataFrame:
    """The first successful attempt of every execution; executions that never succeeded are left out."""
    rest = [c for c in log.columns if c not in ("execution_id", "executed_at")]
    done = log.where(F.col("status") == SUCCESS).groupBy("execution_id").agg(F.min(F.struct("executed_at", *rest)).alias("a"))
    return done.select("execution_id", "a.*").select(*log.columns)


def latest(log: DataFrame, n: int = 20) -> DataFrame:
    """The n most recent attempts, newest first, without their record ids: a top-k report."""
    return log.drop("record_ids").orderBy(F.col("executed_at").desc(), "execution_id").limit(n)


def record_executions(log: DataFrame) -> DataFrame:
    """(record_id, execution_id): the latest successful execution that staged each record."""
    pairs = log.where(F.col("status") == SUCCESS).select(F.explode("record_ids").alias("record_id"), "executed_at", "execution_id")
    return pairs.groupBy("record_id").agg(F.max(F.struct("executed_at", "execution_id")).alias("e")).select("record_id", "e.execution_id")


def held(log: DataFrame, quarantine: DataFrame, waiting: tuple[str, ...] = ("PENDING", "IN_PROGRESS")) -> DataFrame:
    """(record_id, execution_id) of records that an execution staged and that still wait."""
    return record_executions(log).join(quarantine.where(F.col("healing_status").isin(*waiting)).select("record_id").distinct(), "record_id", "left_semi")


def newest_per(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key. Keys with many rows are cut to one before the shuffle; ties go by all columns that can be ordered."""
    others = [c for c, kind in rows.dtypes if c not in (*keys, at) and not kind.startswith("map")]
    newest = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), *others)
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
