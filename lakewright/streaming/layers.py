"""The layers as streams: raw messages, cleaned rows, standardized rows, each batch written once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakewright.operators import clean, contract, gold, standardize
from lakewright.session import stage
from lakewright.sources.versioned import ConflictError, VersionedTable

MESSAGE = "kafka_key string, raw_value string, topic string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp"


def messages(spark: SparkSession, folder: str, *, files_per_batch: int = 100) -> DataFrame:
    """Stream of messages from Parquet files that appear in a folder."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ingested_at", F.current_timestamp())


def kafka(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """The same from a broker, where the connector is installed."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", "earliest").option("failOnDataLoss", "false").load()
    return rows.select(
        F.col("key").cast("string").alias("kafka_key"), F.col("value").cast("string").alias("raw_value"), "topic", F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_timestamp"), F.current_timestamp().alias("ingested_at"),
    )


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, name: str, *, every: str | None = None) -> StreamingQuery:
    """Run ``handle`` on each batch; without ``every`` all that is there is read, then the query ends."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).queryName(name)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()


def to_clean(good: VersionedTable, parked: VersionedTable, source: str) -> Callable[[DataFrame, int], None]:
    """Batch handler: contract guard, clean rows to one table, the others to the other.

    Each write is known by its source and batch, so a batch that is delivered again after a crash adds nothing.
    """

    def handle(batch: DataFrame, number: int) -> None:
        passed, failed = contract.route(contract.check(batch))
        rows = clean.clean(clean.unpack(passed, ("topic", "kafka_timestamp")))
        good.append(rows, app_id=f"{source}:clean", batch=number)
        parked.append(failed.withColumn("healing_status", F.lit("PENDING")), app_id=f"{source}:parked", batch=number)

    return handle


# -- streams over versioned tables


def changes(spark: SparkSession, table: VersionedTable, *, commits_per_batch: int = 100) -> DataFrame:
    """Stream of the commits of a versioned table: (root, operation, files). Its source is the table's log, so only committed data is ever seen."""
    log = spark.readStream.schema("value string").option("maxFilesPerTrigger", commits_per_batch).option("wholetext", "true").text(table.manifest.log)
    info = F.from_json(F.get_json_object("value", "$.info"), "operation string, files array<string>")
    return log.select(F.lit(table.path).alias("root"), info.alias("i")).select("root", "i.operation", "i.files")


def follow(spark: SparkSession, tables: Sequence[VersionedTable], handle: Callable[[DataFrame, int], None], checkpoint: str, name: str, *, skip_changes: bool = True, every: str | None = None) -> StreamingQuery:
    """Run ``handle`` on the rows that each batch of commits appended to any of the tables, as one query with one checkpoint.

    Commits that rewrite rows (updates, compaction) bring nothing new and are skipped; without ``skip_changes`` they end the stream with an error.
    A batch without rows isn't handed on.
    """
    streams = [changes(spark, t) for t in tables]
    union = streams[0]
    for s in streams[1:]:
        union = union.unionByName(s)

    def run(batch: DataFrame, number: int) -> None:
        commits = batch.collect()  # one row per commit, bounded by commits_per_batch and tables
        if not skip_changes and any(c.operation not in ("append", "skipped", "add columns") for c in commits):
            raise RuntimeError(f"{name}: rows of a source were changed")
        rows = None
        for t in tables:
            files = [f"{c.root}/{f}" for c in commits if c.root == t.path and c.operation == "append" for f in c.files]
            if files:
                part = spark.read.schema(t.schema()).parquet(*files)
                rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        if rows is not None:
            handle(rows, number)

    return start(union, run, checkpoint, name, every=every)


def to_standardized(valid: VersionedTable, held: VersionedTable, audit: VersionedTable, dead: VersionedTable, mappings: Callable[[], DataFrame], day_first: Callable[[DataFrame], DataFrame], source: str) -> Callable[[DataFrame, int], None]:
    """Batch handler: standardize with the mappings as they are at that moment; valid, held and logged rows go to tables of their own.

    Each table's append has its own name, so that after a crash between two of them the batch completes what is missing. A batch that fails as a whole is
    parked as text with the reason, and the stream goes on.
    """

    def handle(batch: DataFrame, number: int) -> None:
        try:
            ref = mappings()
            rows = day_first(batch)
            done = stage(standardize.standardize(rows, standardize.mapping_dict(ref), standardize.anchors(ref), day_first=F.col("day_first")), "stream-standardized")
            good, bad = standardize.route(done)
            valid.append(good.drop("day_first"), app_id=f"{source}:valid", batch=number)
            held.append(bad.drop("fuzzy_audit", "day_first").withColumns({"quarantined_at": F.current_timestamp(), "healing_status": F.lit("PENDING"), "stream_batch": F.lit(number)}), app_id=f"{source}:held", batch=number)
            audit.append(done.select("record_id", "table_name", F.explode("fuzzy_audit").alias("a")).select("record_id", "table_name", "a.*"), app_id=f"{source}:audit", batch=number)
        except ConflictError:
            raise  # another writer: the batch is run again
        except Exception as reason:  # noqa: BLE001
            text = batch.select(F.to_json(F.struct(*batch.columns)).alias("raw_json"), "record_id")
            told = {"error_type": F.lit(type(reason).__name__), "error_message": F.lit(str(reason)[:1000]), "healing_status": F.lit("PENDING"), "failed_at": F.current_timestamp()}
            dead.append(text.withColumns(told), app_id=f"{source}:dead", batch=number)

    return handle


def to_business(business: VersionedTable) -> Callable[[DataFrame, int], None]:
    """Batch handler: standardized rows of any source as business rows in one table."""

    def handle(batch: DataFrame, number: int) -> None:
        business.append(gold.derived(gold.typed(batch.withColumnRenamed("table_name", "source_table"))), app_id="business", batch=number)

    return handle


def refresh(business: VersionedTable, metrics: dict[str, VersionedTable], build: dict[str, Callable[[DataFrame], DataFrame]], failures: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """Batch handler that only takes notice: all aggregates are made anew from one version of the business rows, and carry its number.

    An aggregate that fails keeps its last state and is noted; the next notice makes it again.
    """

    def handle(batch: DataFrame, number: int) -> None:
        version = business.version()
        rows = gold.real_crashes(business.read(version))
        for name, make in build.items():
            try:
                metrics[name].overwrite(make(rows).withColumns({"business_version": F.lit(version), "refreshed_at": F.current_timestamp()}))
            except Exception as reason:  # noqa: BLE001
                (failures if failures is not None else []).append(f"{name}: {reason}")

    return handle


def run_layers(starts: Sequence[Callable[[], StreamingQuery]]) -> None:
    """Start queries in order, each when the one before has read all there was; the first failure stops those that still run and is raised."""
    running: list[StreamingQuery] = []
    try:
        for begin in starts:
            running.append(begin())
            running[-1].awaitTermination()
    finally:
        for query in running:
            if query.isActive:
                query.stop()
