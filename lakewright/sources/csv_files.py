"""CSV parts of several tables, in natural order, replayed table by table or interleaved in batches."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.session import stage


def natural_key(name: str) -> list[tuple[int, int | str]]:
    """Order of names in which part2 precedes part10."""
    return [(0, int(x)) if x.isdigit() else (1, x.lower()) for x in re.split(r"(\d+)", name) if x]


def part_files(spark: SparkSession, folder: str, *, allow: Sequence[str] | None = None) -> list[str]:
    """CSV files below a folder in natural order of their names; with ``allow`` only those of these names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path) if x.isFile()] if fs.exists(path) else []
    wanted = [n for n in names if n.lower().endswith(".csv") and (allow is None or n in allow)]
    return [f"{folder.rstrip('/')}/{n}" for n in sorted(wanted, key=natural_key)]


def scan(spark: SparkSession, files: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of the files as texts, with ``part``, the place of the row's file in the list. Blank is NULL; files without a column have NULL there."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    parts = []
    for k, file in enumerate(files):
        head = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(file)
        parts.append(head.select(F.lit(k).alias("part"), *(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) if c in head.columns else F.lit(None).cast("string").alias(c) for c in columns)))
    out = spark.createDataFrame([], T.StructType([T.StructField("part", T.IntegerType(), False), *schema.fields]))
    for p in parts:
        out = out.unionByName(p)
    return out


def discovered(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables that have a folder of their own."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory() and not x.getPath().getName().startswith(("_", "."))), key=natural_key) if fs.exists(path) else []


def batches(tables: Mapping[str, DataFrame], size: int, *, interleaved: bool = True, order: Sequence[str] = ("part",)) -> DataFrame:
    """Rows of all tables with table_name and the number of their batch of at most ``size`` rows.

    Interleaved, batch n holds the n-th rows of every table; else the tables follow one another. Rows are numbered by the place of their partition
    and within it: no table is put in one task.
    """
    out, before = None, 0
    for name, df in tables.items():
        rows = stage(df.sortWithinPartitions(*order), "csv-rows").withColumn("_id", F.monotonically_increasing_id())
        numbered = rows.withColumn("_p", F.shiftright("_id", 33)).withColumn("_k", F.col("_id").bitwiseAND((1 << 33) - 1))
        counts = {r._p: r.n for r in numbered.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row per partition
        offsets, total = {}, 0
        for p in sorted(counts):
            offsets[p], total = total, total + counts[p]
        start = F.create_map(*(F.lit(x) for pair in offsets.items() for x in pair)) if offsets else F.create_map().cast("map<bigint,int>")
        batch = F.floor((F.try_element_at(start, F.col("_p")) + F.col("_k")) / size) + (0 if interleaved else before)
        before += -(-total // size)
        part = numbered.select(F.lit(name).alias("table_name"), batch.cast("bigint").alias("batch_id"), *df.columns)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
