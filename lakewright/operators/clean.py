"""Envelopes unpacked into the crash columns and cleaned: trimmed, in one case, blanks as NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions.barrier import hold
from lakewright.sources.envelopes import fields, parsed, text_field
from lakewright.vocab import CRASH_COLUMNS

# Columns by the case they are kept in; the others keep their own.
LOWER = ("prim_contributory_cause", "sec_contributory_cause")
TITLE = ("street_name",)
AS_IS = (
    "crash_record_id", "crash_date", "posted_speed_limit", "date_police_notified", "street_no", "beat_of_occurrence",
    "num_units", "crash_month", "injuries_total", "injuries_fatal", "injuries_incapacitating",
    "injuries_non_incapacitating", "injuries_reported_not_evident", "injuries_no_indication", "injuries_unknown",
    "crash_hour", "crash_day_of_week", "idot_control_no", "latitude", "longitude", "location", "lane_cnt",
)
UPPER = tuple(c for c in CRASH_COLUMNS if c not in (*LOWER, *TITLE, *AS_IS))


def cleaned(name: str, value: Column) -> Column:
    """One crash column in its clean form."""
    text = F.trim(value)
    text = F.lower(text) if name in LOWER else F.initcap(text) if name in TITLE else F.upper(text) if name in UPPER else text
    return F.nullif(text, F.lit(""))


def unpack(bronze: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., record_id, batch_id, table_name, ingestion_ts, 49 columns) of the readable envelopes, nested or flat."""
    meta = ("record_id", "batch_id", "table_name", "ingestion_ts")
    rows = hold(parsed(bronze.select(*keep, "raw_value"), "raw_value"), *(text_field("envelope", c).alias(f"_m_{c}") for c in meta))
    rows = fields(rows)
    value = lambda c: F.expr(f"try_variant_get(try_element_at(fields, '{c}'), '$', 'string')")
    envelope = (F.col(f"_m_{c}").try_cast("bigint").alias(c) if c == "batch_id" else F.col(f"_m_{c}").alias(c) for c in meta)
    return rows.select(*keep, *envelope, *(value(c).alias(c) for c in CRASH_COLUMNS))


def clean(rows: DataFrame) -> DataFrame:
    """Clean crash columns; all others pass through."""
    return rows.select(*(cleaned(c, F.col(c)).alias(c) if c in CRASH_COLUMNS else F.col(c) for c in rows.columns))
