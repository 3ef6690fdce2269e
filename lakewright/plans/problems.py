"""Queries of the general data-processing problems, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators import bad_rows, drift, late_events, once, timestamps
from lakewright.functions.barrier import hold
from lakewright.session import fresh_path, stage
from lakewright.sources.envelopes import parsed, text_field, uuid_hex
from lakewright.sources.tables import table
from lakewright.vocab import CRASH_COLUMNS, WHOLE_NUMBER_COLUMNS

CORRECTS_DAYS, CUTOFF_DAYS = 2, 14
POSITION = ("topic", "kafka_partition", "kafka_offset")
ORDER = ("kafka_timestamp", *POSITION)


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return late_events.classify(
        table(spark, d, "silver2_crashes"), record_id="record_id", source="table_name", period="crash_date", arrived="ingestion_ts",
        corrects_days=CORRECTS_DAYS, cutoff_days=CUTOFF_DAYS,
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that correct an older day's count, and those past the cut-off."""
    return _outcomes(spark, d).where("outcome <> 'on_time'").select("record_id", "outcome")


def p1_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Corrected count per day: merged counters of the sources, summed."""
    return _by_day(late_events.counted(_outcomes(spark, d)))


def _by_day(counters: DataFrame) -> DataFrame:
    return late_events.period_totals(counters).select(late_events.day_text(F.col("day")).alias("crash_date"), "sources", F.col("n").alias("crashes"))


def p1_counter_state(spark: SparkSession, d: str) -> DataFrame:
    """The counter of every day and source; its version here is the day of the last arrival it counted."""
    state = late_events.counted(_outcomes(spark, d))
    version = F.floor(F.col("last") / F.lit(86_400_000_000)).alias("version")
    return state.select(late_events.day_text(F.col("day")).alias("crash_date"), F.col("source").alias("table_name"), version, F.col("n").alias("crashes"))


def p1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """As p1_daily_counts, but by three batches through a saved state: the middle one comes last, and the first again at the end.

    Batches are cut by time of arrival, and re-sent rows of a record fall into later batches than its first.
    """
    state = late_events.LateState(spark, fresh_path(spark, "p1-state"), corrects_days=CORRECTS_DAYS, cutoff_days=CUTOFF_DAYS)
    rows = table(spark, d, "silver2_crashes").select("record_id", "table_name", "crash_date", "ingestion_ts")
    micros = F.unix_micros(F.col("ingestion_ts").try_cast("timestamp"))
    cuts = rows.select(F.percentile_approx(micros, [0.4, 0.7], 1000).alias("c")).first().c or [0, 0]
    number = sum((F.when(micros > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for k in (0, 2, 1, 0):
        state.apply(rows.where(number == k), f"batch-{k}", record_id="record_id", source="table_name", period="crash_date", arrived="ingestion_ts")
    return _by_day(state.counters())


_P1_SQL = """
WITH f AS (SELECT record_id, min(struct_pack(a := epoch_us(CAST(ingestion_ts AS TIMESTAMPTZ)), day := CAST(crash_date AS DATE), source := table_name)) AS s
           FROM silver2_crashes WHERE record_id IS NOT NULL AND ingestion_ts IS NOT NULL AND crash_date IS NOT NULL AND table_name IS NOT NULL GROUP BY record_id),
r AS (SELECT record_id, s.a AS a, s.day AS day, s.source AS source FROM f),
h AS (SELECT record_id, a, day, source, max(day) OVER (PARTITION BY source ORDER BY a RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM r),
o AS (SELECT *, CASE WHEN date_diff('day', day, h) > 14 THEN 'too_late' WHEN date_diff('day', day, h) >= 2 THEN 'corrects' ELSE 'on_time' END AS outcome FROM h)
"""


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Parked records that can't be loaded, with the reason."""
    return _parked(spark, d, fields=False).where("error_class is not null").select("record_id", "error_class").distinct()


def _parked(spark: SparkSession, d: str, *, fields: bool = True) -> DataFrame:
    return bad_rows.classify(table(spark, d, "silver1_dead_letter").select("record_id", "source_table", "raw_value"), fields=fields)


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Parked records that are good, in the crash columns."""
    return bad_rows.loaded(_parked(spark, d), ("record_id", "source_table")).distinct()


def p2_typed(spark: SparkSession, d: str) -> DataFrame:
    """Values of the typed columns of the good parked records."""
    return bad_rows.typed(_parked(spark, d), ("record_id", "source_table")).distinct()


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Number of parked records by source and outcome."""
    reason = F.coalesce("error_class", F.lit("LOADED")).alias("outcome")
    return _parked(spark, d, fields=False).groupBy("source_table", reason, F.coalesce("bad_column", F.lit("")).alias("bad_column")).agg(F.count("*").alias("records"))


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Position, time and identifier of every delivery that holds a record with a UUID."""
    bronze = parsed(table(spark, d, "bronze_crashes").select(*ORDER, "raw_value"), "raw_value")
    named = hold(bronze.select(*ORDER, "envelope"), uuid_hex(text_field("envelope", "record_id")).alias("id"))
    return named.where("id is not null").drop("envelope")


def p4_once(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery with an identifier, and whether it is the one that stays."""
    state = once.SeenState(spark, fresh_path(spark, "p4-seen"))
    return once.keep_once(stage(deliveries(spark, d), "p4-deliveries"), state, identifier="id", position=POSITION, order=ORDER)


def p4_batches(spark: SparkSession, d: str) -> DataFrame:
    """As p4_once, but in four batches by time through one state: one is delivered twice, and two overlap in time.

    The third batch is selected before the second commits, so that its commit meets a newer state and is made anew.
    """
    state = once.SeenState(spark, fresh_path(spark, "p4-batches"))
    arrivals = stage(deliveries(spark, d), "p4-deliveries")
    micros = F.unix_micros("kafka_timestamp")
    cuts = arrivals.select(F.percentile_approx(micros, [0.25, 0.5, 0.75], 1000).alias("c")).first().c or [0, 0, 0]
    number = sum((F.when(micros > c, 1).otherwise(0) for c in cuts), F.lit(0))
    batch = lambda k: once.Batch(arrivals.where(number == k), state, identifier="id", position=POSITION, order=ORDER, batch=f"part-{k}")
    first = batch(0).prepare().commit()
    third = batch(2).prepare()
    second = batch(1).prepare().commit()
    batch(1).prepare().commit()  # delivered again: nothing changes
    return first.unionByName(second).unionByName(third.commit()).unionByName(batch(3).prepare().commit())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries to drop."""
    return p4_once(spark, d).where("not keep").select(*POSITION)


def p5_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every written time of the crash feed and what it means."""
    return timestamps.normalise(
        table(spark, d, "silver1_crashes"), table(spark, d, "source_profiles"), day_fields=["crash_date"],
        instant_fields=["date_police_notified", "ingestion_ts"],
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Written times that differ from their normal form."""
    return p5_normalised(spark, d).where("value <> normal_value").select("record_id", "field_name", "normal_value").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of the crash keys by source and batch, from the envelopes and from the reported mismatches."""
    found, names = drift.changes(table(spark, d, "bronze_crashes"))
    reported = drift.reported_changes(table(spark, d, "structured_failures"), names)
    return found.unionByName(reported).distinct()


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every readable record in the union schema, whatever its batch called the columns: the crash columns and the added ones."""
    bronze = table(spark, d, "bronze_crashes")
    return drift.unified(bronze, *drift.read_headers(bronze))


def p6_log(spark: SparkSession, d: str) -> DataFrame:
    """The changes of p6_found numbered in order per source."""
    return drift.logged(p6_found(spark, d))


def p6_headers(spark: SparkSession, d: str) -> DataFrame:
    """Keys and types as the envelopes of each batch hold them, with the number of records."""
    heads = drift.headers(table(spark, d, "bronze_crashes"))
    long = heads.select("table_name", "batch_id", "records", F.inline("header"))
    return long.groupBy("table_name", "batch_id", F.col("key").alias("field_name"), "kind").agg(F.sum("records").alias("records"))


def p6_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of every column by source, folded through the promotion lattice."""
    return drift.column_types(table(spark, d, "bronze_crashes")).select("table_name", "field_name", F.array_join("kinds", "|").alias("kinds"), "promoted")


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_daily_counts": p1_daily_counts, "p1_counter_state": p1_counter_state, "p1_incremental": p1_incremental, "p2_found": p2_found, "p2_loaded": p2_loaded, "p2_typed": p2_typed,
        "p2_reasons": p2_reasons, "p4_found": p4_found, "p4_once": p4_once, "p4_batches": p4_batches, "p5_found": p5_found, "p5_normalised": p5_normalised,
        "p6_found": p6_found, "p6_unified": p6_unified, "p6_log": p6_log, "p6_headers": p6_headers, "p6_types": p6_types,
    }


_HEX = "lower(replace(trim(regexp_replace(trim(record_id), '^urn:uuid:', ''), '{}'), '-', ''))"
_ARRIVALS = f"""
WITH e AS (SELECT topic, kafka_partition, kafka_offset, kafka_timestamp, json_extract_string(raw_value, '$.record_id') AS record_id
           FROM bronze_crashes WHERE json_valid(raw_value) AND json_type(raw_value) = 'OBJECT'),
a AS (SELECT kafka_timestamp, topic, kafka_partition, kafka_offset, {_HEX} AS id FROM e WHERE regexp_full_match({_HEX}, '[0-9a-f]{{32}}')),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kafka_timestamp, topic, kafka_partition, kafka_offset) AS n FROM a)
"""


_HEADERS = """
WITH e AS (SELECT json_extract_string(raw_value, '$.table_name') AS table_name, TRY_CAST(json_extract_string(raw_value, '$.batch_id') AS BIGINT) AS batch_id, raw_value AS j
           FROM bronze_crashes WHERE json_valid(raw_value) AND json_type(raw_value) = 'OBJECT'),
p AS (SELECT table_name, batch_id, json_type(j, '$.payload') AS inner_type, CASE WHEN json_type(j, '$.payload') = 'OBJECT' THEN json_extract(j, '$.payload') ELSE j END AS f FROM e WHERE table_name IS NOT NULL AND batch_id IS NOT NULL),
k AS (SELECT table_name, batch_id, x.key AS field_name, CASE WHEN x.type = 'VARCHAR' THEN 'string' WHEN x.type = 'NULL' THEN 'void' WHEN x.type IN ('BOOLEAN', 'OBJECT', 'ARRAY') THEN lower(x.type) ELSE 'number' END AS kind
      FROM p, json_each(p.f) x WHERE inner_type = 'OBJECT' OR (inner_type IS NULL AND x.key NOT IN ('record_id', 'batch_id', 'table_name', 'ingestion_ts', 'payload')))
"""
_FIELD = '("(?:[^"]|"")*"|[^",]*)'


def _value(column: str) -> str:
    return f"trim(f[{CRASH_COLUMNS.index(column) + 1}])"


def _bad_value(column: str) -> str:
    """SQL condition that a field's text is no value of its column."""
    v = _value(column)
    if column in WHOLE_NUMBER_COLUMNS:
        ok = f"regexp_full_match({v}, '[0-9]+')" + (f" AND TRY_CAST({v} AS HUGEINT) <= 23" if column == "crash_hour" else "")
    elif column == "crash_date":
        ok = f"regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST({v} AS DATE) IS NOT NULL"
    else:
        low, high = {"num_units": (0, 1e300), "latitude": (-90, 90), "longitude": (-180, 180)}[column]
        ok = f"regexp_full_match({v}, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') AND TRY_CAST({v} AS DOUBLE) BETWEEN {low} AND {high}"
    return f"{v} <> '' AND NOT COALESCE({ok}, false)"


_TYPED = [c for c in CRASH_COLUMNS if c in (*WHOLE_NUMBER_COLUMNS, "num_units", "latitude", "longitude", "crash_date")]
_PARKED = f"""
WITH r AS (SELECT record_id, source_table, regexp_replace(raw_value, '(\\r\\n|\\n|\\r)$', '') AS raw FROM silver1_dead_letter),
q AS (SELECT record_id, source_table, regexp_full_match(raw, '{_FIELD}(?:,{_FIELD})*') AS ok, list_transform(regexp_extract_all(raw || ',', '{_FIELD},', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM r),
b AS (SELECT *, CASE WHEN ok AND len(f) = {len(CRASH_COLUMNS)} THEN CASE {" ".join(f"WHEN {_bad_value(c)} THEN '{c}'" for c in _TYPED)} END END AS bad_column FROM q),
c AS (SELECT *, CASE WHEN NOT ok THEN 'BROKEN_QUOTING' WHEN len(f) <> {len(CRASH_COLUMNS)} THEN 'WRONG_COLUMN_COUNT' WHEN bad_column IS NOT NULL THEN 'INVALID_VALUE' END AS error_class FROM b)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _PARKED + "SELECT DISTINCT record_id, error_class FROM c WHERE error_class IS NOT NULL",
        "p2_loaded": _PARKED + "SELECT DISTINCT record_id, source_table, " + ", ".join(f"nullif(trim(f[{i}]), '') AS {c}" for i, c in enumerate(CRASH_COLUMNS, 1)) + " FROM c WHERE error_class IS NULL AND ok",
        "p2_typed": _PARKED + "SELECT DISTINCT record_id, source_table, " + ", ".join(f"TRY_CAST({_value(c)} AS {bad_rows.TYPES[c][0]}) AS {c}" for c in _TYPED) + " FROM c WHERE error_class IS NULL AND ok",
        "p2_reasons": _PARKED + "SELECT source_table, COALESCE(error_class, 'LOADED') AS outcome, COALESCE(bad_column, '') AS bad_column, count(*) AS records FROM c GROUP BY ALL",
        "p1_found": _P1_SQL + "SELECT record_id, outcome FROM o WHERE outcome <> 'on_time'",
        "p1_daily_counts": _P1_SQL + "SELECT strftime(day, '%Y-%m-%d') AS crash_date, count(DISTINCT source) AS sources, count(*) AS crashes FROM o WHERE outcome <> 'too_late' GROUP BY day",
        "p1_incremental": _P1_SQL + "SELECT strftime(day, '%Y-%m-%d') AS crash_date, count(DISTINCT source) AS sources, count(*) AS crashes FROM o WHERE outcome <> 'too_late' GROUP BY day",
        "p1_counter_state": _P1_SQL + "SELECT strftime(day, '%Y-%m-%d') AS crash_date, source AS table_name, max(a // 86400000000) AS version, count(*) AS crashes FROM o WHERE outcome <> 'too_late' GROUP BY day, source",
        "p6_headers": _HEADERS + "SELECT table_name, batch_id, field_name, kind, count(*) AS records FROM k GROUP BY ALL",
        "p4_found": _ARRIVALS + "SELECT topic, kafka_partition, kafka_offset FROM k WHERE n > 1",
        "p4_batches": _ARRIVALS + "SELECT kafka_timestamp, topic, kafka_partition, kafka_offset, id, n = 1 AS keep FROM k",
        "p4_once": _ARRIVALS + "SELECT kafka_timestamp, topic, kafka_partition, kafka_offset, id, n = 1 AS keep FROM k",
    }
