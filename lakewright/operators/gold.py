"""Typed business rows over all sources, and the aggregates kept from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INJURIES = ("injuries_total", "injuries_fatal", "injuries_incapacitating", "injuries_non_incapacitating", "injuries_reported_not_evident", "injuries_no_indication")
TEXTS = (
    "crash_record_id", "record_id", "source_table", "crash_day_of_week", "crash_month", "beat_of_occurrence", "street_direction", "street_name",
    "traffic_control_device", "device_condition", "weather_condition", "lighting_condition", "roadway_surface_cond", "road_defect", "trafficway_type",
    "alignment", "intersection_related_i", "crash_type", "first_crash_type", "prim_contributory_cause", "sec_contributory_cause", "private_property_i",
    "damage", "most_severe_injury",
)


def union_sources(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables by column name, tagged with the name of the source; columns that a table lacks are NULL."""
    tagged = [df.withColumn("source_table", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def whole(value: Column) -> Column:
    """Integer of a text that may have decimals; NULL if it is no number."""
    return value.try_cast("double").try_cast("int")


def typed(rows: DataFrame) -> DataFrame:
    """Typed columns of standardized rows."""
    return rows.select(
        *TEXTS, F.col("crash_date").try_cast("date").alias("crash_date"), whole(F.col("crash_hour")).alias("crash_hour"),
        F.col("latitude").try_cast("double").alias("latitude"), F.col("longitude").try_cast("double").alias("longitude"),
        F.col("posted_speed_limit").try_cast("int").alias("posted_speed_limit"), F.col("num_units").try_cast("int").alias("num_units"),
        F.col("hit_and_run_i").try_cast("boolean").alias("hit_and_run_i"), *(whole(F.col(c)).alias(c) for c in INJURIES),
    )


def derived(rows: DataFrame) -> DataFrame:
    """Adds year, weekend, time of day, injury, fatality and injection flags."""
    hour = F.col("crash_hour")
    band = F.when(hour.isNull(), None).when(hour.between(6, 11), "MORNING").when(hour.between(12, 16), "AFTERNOON").when(hour.between(17, 20), "EVENING").otherwise("NIGHT")
    return rows.withColumns({
        "crash_year": F.year("crash_date"), "is_weekend": F.col("crash_day_of_week").isin("SATURDAY", "SUNDAY"), "time_of_day": band,
        "is_injury_crash": F.col("injuries_total") > 0, "is_fatal_crash": F.col("injuries_fatal") > 0,
        "is_injected": F.coalesce(F.col("crash_record_id").like("FAULT-%"), F.lit(False)),
    })


def once(rows: DataFrame, key: str = "crash_record_id", order: str = "record_id") -> DataFrame:
    """One row per business key, the least ``order`` (repeats of it keep one); rows without key all stay.

    Least rows are found with a struct minimum before the shuffle, so that a key that holds many rows is no hot spot.
    """
    with_key = rows.where(F.col(key).isNotNull())
    least = with_key.groupBy(key).agg(F.min(F.struct(order, *(c for c in rows.columns if c not in (key, order)))).alias("_r"))
    return least.select(*(F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns)).unionByName(rows.where(F.col(key).isNull()))


def real_crashes(rows: DataFrame) -> DataFrame:
    """Rows that count: not injected, each business key once."""
    return once(rows.where(~F.coalesce("is_injected", F.lit(False))))


def _flag(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def _counts() -> list[Column]:
    return [
        F.count("*").alias("crashes"), _flag(F.col("is_injury_crash")).alias("injury_crashes"), _flag(F.col("is_fatal_crash")).alias("fatal_crashes"),
        F.coalesce(F.sum("injuries_total"), F.lit(0)).alias("injuries_total"), F.coalesce(F.sum("injuries_fatal"), F.lit(0)).alias("injuries_fatal"),
    ]


def _share(c: Column) -> Column:
    return F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)


def _rates() -> list[Column]:
    return [_share(F.col("is_injury_crash")).alias("injury_rate"), _share(F.col("is_fatal_crash")).alias("fatal_rate")]


def daily(rows: DataFrame) -> DataFrame:
    days = rows.where("crash_date is not null").groupBy("crash_date", "crash_year")
    return days.agg(F.min("is_weekend").alias("is_weekend"), *_counts(), _flag(F.col("hit_and_run_i")).alias("hit_and_run_crashes"))


def conditions(rows: DataFrame) -> DataFrame:
    keys = [F.coalesce(c, F.lit("NOT RECORDED")).alias(c) for c in ("weather_condition", "lighting_condition", "roadway_surface_cond")]
    return rows.groupBy(*keys).agg(*_counts(), *_rates())


def time_pattern(rows: DataFrame) -> DataFrame:
    hours = rows.where("crash_day_of_week is not null and crash_hour is not null").groupBy("crash_day_of_week", "crash_hour")
    return hours.agg(F.min("time_of_day").alias("time_of_day"), *_counts(), *_rates())


def causes(rows: DataFrame) -> DataFrame:
    by = rows.groupBy(F.coalesce("prim_contributory_cause", F.lit("not recorded")).alias("prim_contributory_cause")).agg(*_counts(), *_rates())
    total = F.sum("crashes").over(Window.partitionBy())  # over one row per cause
    return by.withColumn("share_of_crashes", F.round(F.col("crashes") / total, 4))


def areas(rows: DataFrame) -> DataFrame:
    month = F.trunc("crash_date", "month").alias("month_start")
    return rows.where("beat_of_occurrence is not null and crash_date is not null").groupBy("beat_of_occurrence", month).agg(
        *_counts(), *_rates(), _share(F.col("time_of_day") == "NIGHT").alias("night_share"), _share(F.col("is_weekend")).alias("weekend_share"),
        _share(F.col("weather_condition").isin("RAIN", "SNOW", "FOG")).alias("adverse_weather_share"), _share(F.col("hit_and_run_i")).alias("hit_and_run_share"),
        F.round(F.avg(F.col("posted_speed_limit").cast("double")), 1).alias("avg_posted_speed_limit"),
    )


METRICS = {"daily": daily, "conditions": conditions, "time_pattern": time_pattern, "causes": causes, "areas": areas}


def metrics(gold: DataFrame) -> dict[str, DataFrame]:
    """All aggregates over one snapshot."""
    rows = real_crashes(gold)
    return {name: build(rows) for name, build in METRICS.items()}
