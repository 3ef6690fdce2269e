"""Values of the clean table standardized by declared rules, with the columns that resist listed per record.

Exact spellings come from the mapping table; misspelt ones are matched to anchors (seed spellings) with a guard: the best
canonical value must be near enough and clearly nearer than any other. Dates go through an ordered chain of formats in the
source's day or month order. All but the guarded match stays in JVM expressions; the match runs on rows that no exact rule
resolves and remembers each distinct value.

Defined results: NULL and blank input gives NULL and no failure, save for the mandatory crash_date; unknown sources read month first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.functions.distance import damerau

MAPPED = ("weather_condition", "lighting_condition", "damage", "hit_and_run_i", "street_direction", "crash_month", "crash_day_of_week", "crash_hour", "num_units")
FUZZY = ("weather_condition", "lighting_condition", "street_direction", "crash_month", "crash_day_of_week")
TRACKED = ("crash_date", "weather_condition", "lighting_condition", "hit_and_run_i", "damage", "street_direction", "num_units", "crash_month", "crash_hour", "crash_day_of_week", "date_police_notified", "posted_speed_limit")
MISSING = "MISSING_MANDATORY_VALUE"

# Accepted date notations, in the order in which they are tried.
ISO = ("yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd")
MONTH_FIRST = ("M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy", "MM-dd-yyyy")
DAY_FIRST = ("d/M/yyyy h:mm:ss a", "d/M/yyyy H:mm:ss", "d/M/yyyy", "dd-MM-yyyy")
COMPACT = ("yyyyMMdd",)
CLOCK = ("h a", "hh a", "HH:mm", "h:mm a", "hh:mm a", "HH.mm", "h.mm a", "hh.mm a")

# The damage classes, which feeds deliver as they are.
DAMAGE = ("OVER $1,500", "$501 - $1,500", "$500 OR LESS")

# Limits of the guarded match.
MIN_LENGTH, SHARE, MARGIN = 4, 0.25, 2
SYNONYM_LETTERS, SYNONYM_DISTANCE, ANCHOR_LETTERS = 6, 1, 3

#: Spellings of the mapping table that are held in memory at most; a longer list is refused.
MAX_SPELLINGS = 100_000


def latest_mappings(mappings: DataFrame) -> DataFrame:
    """(field_name, spelling, canonical_value): the latest row of each spelling, upper case and trimmed."""
    newest = Window.partitionBy("field_name", "spelling").orderBy(F.col("added_at").desc_nulls_last(), F.col("canonical_value").desc())
    rows = mappings.select("field_name", F.upper(F.trim("raw_synonym")).alias("spelling"), "canonical_value", "added_at").where("spelling is not null and canonical_value is not null")
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("field_name", "spelling", "canonical_value")


def with_spellings(mappings: DataFrame, field: str, values: Sequence[str]) -> DataFrame:
    """The mapping table with values of a field that stand for themselves, as seed rows older than any other."""
    rows = mappings.sparkSession.createDataFrame([(field, v, v, "seed") for v in values], "field_name string, raw_synonym string, canonical_value string, added_by string")
    return mappings.unionByName(rows.withColumn("added_at", F.lit("1970-01-01").cast("timestamp")), allowMissingColumns=True)


def overlay(base: Mapping[str, Mapping[str, str]], changes: Mapping[str, Mapping[str, str]]) -> dict[str, dict[str, str]]:
    """A copy of the mappings with further spellings; empty ones are ignored."""
    out = {field: dict(m) for field, m in base.items()}
    for field, more in changes.items():
        out.setdefault(field, {}).update({k.strip().upper(): v for k, v in more.items() if k and k.strip()})
    return out


def mapping_dict(mappings: DataFrame) -> dict[str, dict[str, str]]:
    """Exact mappings by field, in memory by the bound that is checked here."""
    rows = latest_mappings(mappings).limit(MAX_SPELLINGS + 1).collect()
    if len(rows) > MAX_SPELLINGS:
        raise ValueError(f"more than {MAX_SPELLINGS} spellings")
    out: dict[str, dict[str, str]] = {}
    for r in rows:
        out.setdefault(r.field_name, {})[r.spelling] = r.canonical_value
    return out


def anchors(mappings: DataFrame, *, spellings: bool = True) -> dict[str, list[tuple[str, str]]]:
    """field -> (anchor, canonical): seed spellings that speak for one canonical value, and the canonical values themselves."""
    seeds = mappings.where("added_by = 'seed'").select("field_name", F.upper(F.trim("raw_synonym")).alias("s"), F.upper(F.trim("canonical_value")).alias("c")).distinct().limit(MAX_SPELLINGS + 1).collect()
    if len(seeds) > MAX_SPELLINGS:
        raise ValueError(f"more than {MAX_SPELLINGS} spellings")
    out: dict[str, dict[str, set[str]]] = {}
    for r in seeds:
        field = out.setdefault(r.field_name, {})
        field.setdefault(r.c, set()).add(r.c)
        if spellings and sum(x.isalpha() for x in r.s) >= ANCHOR_LETTERS:
            field.setdefault(r.s, set()).add(r.c)
    return {f: sorted((s, s if s in cs else min(cs)) for s, cs in field.items() if len(cs) == 1 or s in cs) for f, field in out.items()}


def guarded(value: str | None, of: list[tuple[str, str]]) -> tuple[str, int] | None:
    """(canonical value, distance) that a misspelt value certainly means, else None."""
    key = (value or "").strip().upper()
    if len(key) < MIN_LENGTH:
        return None
    most = max(1, int(len(key) * SHARE))
    best: tuple[int, str] | None = None
    nearest: dict[str, int] = {}
    for spelling, canonical in of:
        apart = abs(len(key) - len(spelling))
        d = damerau(key, spelling) if apart < most + MARGIN else most + MARGIN  # so far away it neither wins nor competes
        nearest[canonical] = min(d, nearest.get(canonical, d))
        may_win = spelling == canonical or (sum(x.isalpha() for x in spelling) >= SYNONYM_LETTERS and d <= SYNONYM_DISTANCE)
        if may_win and (best is None or (d, canonical) < best):
            best = (d, canonical)
    if best is None or best[0] > most:
        return None
    other = min((d for c, d in nearest.items() if c != best[1]), default=1000)
    return (best[1], best[0]) if other - best[0] >= MARGIN else None


def fuzzy_column(field: str, value: Column, of: list[tuple[str, str]]) -> Column:
    """struct<canonical, distance> of guarded() for each value; NULL values aren't matched."""

    @F.pandas_udf("canonical string, distance int")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple] = {}
        for values in batches:
            out = []
            for v in values:
                if v is None:
                    out.append((None, None))
                    continue
                if v not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[v] = guarded(v, of) or (None, None)
                out.append(memo[v])
            yield pd.DataFrame(out, columns=["canonical", "distance"]).astype({"distance": "Int32"})

    return match(value)


def exact(field: str, value: Column, mappings: Mapping[str, Mapping[str, str]]) -> Column:
    """Canonical value of an accepted spelling, NULL if there is none."""
    known = mappings.get(field)
    if not known:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair)), F.upper(F.trim(value)))


def shape(form: str) -> str:
    """Regular expression of the texts that a format can fit."""
    widths = {"yyyy": r"\d{4}", "SSS": r"\d{3}", "a": "[AaPp][Mm]"}
    out = ""
    for m in re.finditer(r"'([^']*)'|(([A-Za-z])\3*)|([^A-Za-z'])", form):
        if m[1] is not None or m[4] is not None:
            out += re.escape(m[1] if m[1] is not None else m[4])
        else:
            out += widths.get(m[2], r"\d{2}" if len(m[2]) == 2 else r"\d{1,2}")
    return f"^{out}$"


def first_time(value: Column, formats: tuple[str, ...]) -> Column:
    """Timestamp by the first format that fits. Only texts of a format's shape are parsed: a failed attempt is dear."""
    return F.coalesce(*(F.when(value.rlike(shape(f)), F.try_to_timestamp(value, F.lit(f))) for f in formats))


def standard_date(value: Column, day_first: Column) -> Column:
    """yyyy-MM-dd; day-first sources are strict, month-first ones fall back to day first."""
    month = F.date_format(first_time(value, (*ISO, *MONTH_FIRST, *DAY_FIRST, *COMPACT)), "yyyy-MM-dd")
    day = F.date_format(first_time(value, (*ISO, *DAY_FIRST, *COMPACT)), "yyyy-MM-dd")
    return F.when(day_first, day).otherwise(month)


def standard_time(value: Column, day_first: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss in the source's order only."""
    iso = tuple(f for f in ISO if f != "yyyy/MM/dd")
    form = lambda formats: F.date_format(first_time(value, formats), "yyyy-MM-dd HH:mm:ss")
    return F.when(day_first, form((*iso, *DAY_FIRST))).otherwise(form((*iso, *MONTH_FIRST)))


def standard_hour(value: Column, mapped: Column) -> Column:
    """HH.00 of a clock time, a number or a mapped word."""
    text = F.trim(value)
    number = F.when(text.rlike(r"^\d{1,2}(\.\d+)?$"), F.floor(text.try_cast("decimal(10,2)")).cast("int"))
    digits = F.when(text.rlike(r"^\d{1,3}$"), text.try_cast("int"))
    hour = F.coalesce(mapped.try_cast("int"), F.hour(first_time(value, CLOCK)), number, digits)
    return F.when(hour.between(0, 23), F.format_string("%02d.00", hour))


def standard_units(value: Column, mapped: Column) -> Column:
    """Number with one decimal: a mapped word, else the first number in the text."""
    return F.coalesce(mapped.try_cast("decimal(10,1)"), F.regexp_extract(value, r"(\d{1,8}(\.\d+)?)", 1).try_cast("decimal(10,1)"))


def standard_speed(value: Column) -> Column:
    """The first run of up to four digits."""
    return F.regexp_extract(value, r"(\d{1,4})", 1).try_cast("int")


def standardize(df: DataFrame, mappings: Mapping[str, Mapping[str, str]], of: Mapping[str, list[tuple[str, str]]], *, day_first: Column) -> DataFrame:
    """Rows with standardized columns, ``columns_to_remediate`` (map of raw values), ``fuzzy_audit`` and the untouched ``raw_record``."""
    rows = df.withColumn("raw_record", F.struct(*df.columns))
    for c in FUZZY:
        unresolved = F.when(exact(c, F.col(c), mappings).isNull(), F.col(c))
        rows = rows.withColumn(f"_f_{c}", fuzzy_column(c, unresolved, list(of.get(c, []))))
    std: dict[str, Column] = {c: F.coalesce(exact(c, F.col(c), mappings), F.col(f"_f_{c}.canonical")) for c in FUZZY}
    std |= {
        "damage": exact("damage", F.col("damage"), mappings), "hit_and_run_i": exact("hit_and_run_i", F.col("hit_and_run_i"), mappings).try_cast("boolean"),
        "crash_date": standard_date(F.col("crash_date"), day_first), "date_police_notified": standard_time(F.col("date_police_notified"), day_first),
        "crash_hour": standard_hour(F.col("crash_hour"), exact("crash_hour", F.col("crash_hour"), mappings)),
        "num_units": standard_units(F.col("num_units"), exact("num_units", F.col("num_units"), mappings)), "posted_speed_limit": standard_speed(F.col("posted_speed_limit")),
    }
    rows = rows.withColumns({f"_s_{c}": v for c, v in std.items()})
    failed = []
    for c in TRACKED:
        bad = F.col(f"_s_{c}").isNull() if c == "crash_date" else F.col(c).isNotNull() & (F.trim(F.col(c)) != "") & F.col(f"_s_{c}").isNull()
        value = F.coalesce(F.col(c), F.lit(MISSING)) if c == "crash_date" else F.col(c).cast("string")
        failed.append(F.when(bad, F.struct(F.lit(c).alias("key"), value.alias("value"))))
    audit = [F.when(F.col(f"_f_{c}.canonical").isNotNull(), F.struct(F.lit(c).alias("field"), F.col(c).alias("raw"), F.col(f"_f_{c}.canonical").alias("matched"), F.col(f"_f_{c}.distance").alias("distance"))) for c in FUZZY]
    rows = rows.withColumn("columns_to_remediate", F.map_from_entries(F.array_compact(F.array(*failed)))).withColumn("fuzzy_audit", F.array_compact(F.array(*audit)))
    rows = rows.withColumns({c: F.col(f"_s_{c}") for c in TRACKED})
    return rows.drop(*(f"_s_{c}" for c in TRACKED), *(f"_f_{c}" for c in FUZZY))


def route(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) rows."""
    valid = F.size("columns_to_remediate") == 0
    return rows.where(valid).drop("columns_to_remediate", "fuzzy_audit", "raw_record"), rows.where(~valid)
