"""Texts in many date and time notations and zones, normalised to one calendar day or one UTC instant.

All notations are compiled into one regular expression, an alternation whose branches have named groups. Each distinct text of an
Arrow batch is matched once and its components extracted once; everything after that (calendar ranges, days by integer
arithmetic, zone offsets, text of the result) is done on whole columns. There is no shuffle: sources' profiles are a
small table whose size is checked.

Rules: numeric dates that begin with day or month follow the source's order strictly; a four-digit beginning is year, month,
day; two-digit years are 20xx; fourteen bare digits that read as year (1900 to 2199), month, day and clock are that; other nine to nineteen bare
digits count from 1970 in seconds, milli-, micro- or nanoseconds by their number. Without a zone the source's clock holds; a local time that occurs twice means the earlier instant. Text that names no
existing day or time, or a local time that the clock skips, is UNRESOLVED, and so is a zone-less time of a source without
profile. NULL stays NULL; blank text is UNRESOLVED.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone
from functools import cache, lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNRESOLVED = "UNRESOLVED"

#: Profiles (one row per source) that the driver reads at most; a longer table is refused.
MAX_PROFILES = 10_000
#: Years a date can have.
FIRST_YEAR, LAST_YEAR = 1, 9999

# Month and weekday names.
MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")
WEEKDAYS = ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")

_MONTH = "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") for m in MONTHS).replace("SEP(?:TEMBER)?", "SEP(?:T(?:EMBER)?)?")
_WEEKDAY = "(?:(?:" + "|".join(f"{w[:3]}(?:{w[3:]})?" for w in WEEKDAYS) + r")\.?,? )?"
_ZONE = r" ?<z:Z|[A-Z]{3,5}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?>"
_CLOCK = rf"(?:(?:T| T? ?|, ?)<h:\d{{1,2}}>:<i:\d{{2}}>(?::<s:\d{{2}}>(?:[.,]\d{{1,12}})?)?(?: ?<p:[AP]>\.?M\.?)?(?:{_ZONE})?)?"
_ORDINAL = "(?:ST|ND|RD|TH)?"

#: The notations, upper case. <c:rx> is component c: y year, m month, d day, a and b the first two numbers of a date in the
#: source's order, n month name, h i s clock, p half of the day, z zone, e count from 1970.
NOTATIONS = (
    rf"<y:\d{{4}}>-<m:\d{{1,2}}>-<d:\d{{1,2}}>{_CLOCK}",
    rf"<y:\d{{4}}>/<m:\d{{1,2}}>/<d:\d{{1,2}}>{_CLOCK}",
    rf"<y:\d{{4}}>\.<m:\d{{1,2}}>\.<d:\d{{1,2}}>{_CLOCK}",
    rf"<y:\d{{4}}><m:\d{{2}}><d:\d{{2}}>(?:[T ]<h:\d{{2}}><i:\d{{2}}>(?:<s:\d{{2}}>(?:[.,]\d{{1,12}})?)?(?:{_ZONE})?)?",
    rf"<y:\d{{4}}><m:\d{{2}}><d:\d{{2}}>{_CLOCK}",
    r"<y:(?:19|2[01])\d{2}><m:0[1-9]|1[0-2]><d:0[1-9]|[12]\d|3[01]><h:[01]\d|2[0-3]><i:[0-5]\d><s:[0-5]\d>",
    r"<e:\d{9,19}>",
    rf"<a:\d{{1,2}}>/<b:\d{{1,2}}>/<y:\d{{4}}|\d{{2}}>{_CLOCK}",
    rf"<a:\d{{1,2}}>-<b:\d{{1,2}}>-<y:\d{{4}}|\d{{2}}>{_CLOCK}",
    rf"<a:\d{{1,2}}>\.<b:\d{{1,2}}>\.<y:\d{{4}}|\d{{2}}>{_CLOCK}",
    rf"{_WEEKDAY}<d:\d{{1,2}}>{_ORDINAL}(?: OF)?[ -]<n:{_MONTH}>\.?,?[ -]<y:\d{{4}}|\d{{2}}>{_CLOCK}",
    rf"{_WEEKDAY}<n:{_MONTH}>\.? <d:\d{{1,2}}>{_ORDINAL},? <y:\d{{4}}>{_CLOCK}",
    rf"{_WEEKDAY}<n:{_MONTH}> <d:\d{{1,2}}> <h:\d{{2}}>:<i:\d{{2}}>:<s:\d{{2}}>(?: <z:[A-Z]{{3,5}}|(?:UTC|GMT)?[+-]\d{{2}}:?\d{{2}}>)? <y:\d{{4}}>",
)
COMPONENTS = "ymdabnhispze"


@cache
def alternation() -> tuple[re.Pattern, dict[str, tuple[int, ...]]]:
    """The notations as one pattern, and for each branch the group numbers of COMPONENTS (0 where it has none)."""
    branches = []
    for k, notation in enumerate(NOTATIONS):
        branches.append(f"(?P<branch{k}>{_close(notation, k)})")
    rx = re.compile("(?:" + "|".join(branches) + r")\Z")
    index = rx.groupindex
    return rx, {f"branch{k}": tuple(index.get(f"{c}{k}", 0) for c in COMPONENTS) for k in range(len(NOTATIONS))}


def _close(notation: str, branch: int) -> str:
    """<c:rx> -> (?P<c{branch}>rx)."""
    return re.sub(r"<([a-z]):([^<>]*)>", rf"(?P<\g<1>{branch}>\2)", notation)


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates, in integers."""
    year = y - (m <= 2)
    era = year // 400
    of_era = year - era * 400
    of_year = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146_097 + of_era * 365 + of_era // 4 - of_era // 100 + of_year - 719_468


def month_days(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Number of days of months."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + (leap & (m == 2))


def _offset(zone: ZoneInfo, second: int) -> int:
    """Offset in seconds that a zone has at an instant."""
    at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=second)
    return int(at.astimezone(zone).utcoffset().total_seconds())


@lru_cache(maxsize=100_000)
def year_changes(zone: str, year: int) -> tuple[int, int, tuple[tuple[int, int], ...]]:
    """(first second, offset then, changes as (second, new offset)) of one year of a zone, in UTC, looked for day by day."""
    at, day = ZoneInfo(zone), 86_400
    start, end = (int(days_from_civil(*(np.array([x]) for x in (y, 1, 1)))[0]) * day for y in (year, year + 1))
    if year == FIRST_YEAR:
        start += day  # the clock of the first and last day may lie outside the years there are
    if year == LAST_YEAR:
        end -= day
    first = now = _offset(at, start)
    changes = []
    for low in range(start, end, day):
        if _offset(at, low + day) == now:
            continue
        high = low + day
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if _offset(at, mid) != now else (mid, high)
        now = _offset(at, high)
        changes.append((high, now))
    return start, first, tuple(changes)


@lru_cache(maxsize=1_000)
def transitions(zone: str, years: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(instants, offsets) for the given years and their neighbours: offsets[k] holds before instants[k] and after instants[k - 1]."""
    cuts: list[int] = []
    offsets: list[int] = []
    for year in sorted({y for near in years for y in (near - 1, near, near + 1) if FIRST_YEAR <= y <= LAST_YEAR}):
        start, first, changes = year_changes(zone, year)
        if not offsets:
            offsets.append(first)
        elif first != offsets[-1]:  # it changed in years that aren't wanted
            cuts.append(start)
            offsets.append(first)
        for second, offset in changes:
            cuts.append(second)
            offsets.append(offset)
    return np.array(cuts, dtype=np.int64), np.array(offsets, dtype=np.int64)


def _table(seconds: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray]:
    years = np.unique(seconds.astype("datetime64[s]").astype("datetime64[Y]").astype(np.int64) + 1970)
    return transitions(zone, tuple(np.clip(years, FIRST_YEAR, LAST_YEAR).tolist()) or (1970,))


@cache
def abbreviations(zone: str) -> dict[str, int]:
    """Offsets of the zone's abbreviations in use since 2000."""
    at, names = ZoneInfo(zone), {}
    for year in range(2000, 2038):
        start, _, changes = year_changes(zone, year)
        for second in (start, *(x for x, _ in changes)):
            local = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=second)).astimezone(at)
            names.setdefault(local.tzname(), int(local.utcoffset().total_seconds()))
    return {k: v for k, v in names.items() if k.isalpha()}


def to_local(instant: np.ndarray, zone: str) -> np.ndarray:
    """Clock seconds of UTC instants."""
    cuts, offsets = _table(instant, zone)
    return instant + offsets[np.searchsorted(cuts, instant, side="right")]


def to_instant(local: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray]:
    """(UTC seconds, whether the clock ever showed it) of clock seconds; the earlier of two instants."""
    cuts, offsets = _table(local, zone)
    guess = np.searchsorted(cuts, local - offsets.max(), side="right")
    best, found = np.zeros_like(local), np.zeros(len(local), bool)
    for ahead in range(4):  # offsets in force around that time, from the earliest on
        k = np.minimum(guess + ahead, len(offsets) - 1)
        instant = local - offsets[k]
        fits = (np.searchsorted(cuts, instant, side="right") == k) & ~found
        best, found = np.where(fits, instant, best), found | fits
    return best, found


def components(texts: Sequence[str]) -> dict[str, np.ndarray]:
    """Components of each text, -1 where it has none; z as text, matched tells whether a notation fits."""
    rx, groups = alternation()
    space = re.compile(r"\s+")
    months = {m[:3]: k + 1 for k, m in enumerate(MONTHS)}
    rows, zones, matched = [], [], []
    blank = (-1,) * 11
    for text in texts:
        m = rx.match(space.sub(" ", text).strip().upper())
        matched.append(m is not None)
        if m is None:
            rows.append(blank)
            zones.append("")
            continue
        y, mo, d, a, b, n, h, i, s, p, z, e = (m[g] if g else None for g in groups[m.lastgroup])
        year = -1 if y is None else int(y) + 2000 * (len(y) == 2)
        month = months[n[:3]] if n else int(mo or -1)
        half = -1 if p is None else int(p == "P")
        rows.append((year, month, int(d or -1), int(a or -1), int(b or -1), int(h or -1), int(i or 0), int(s or 0), half, int(e or -1), len(e or "")))
        zones.append(z or "")
    columns = np.array(rows, dtype=np.int64).reshape(len(rows), 11).T
    return dict(zip(("y", "m", "d", "a", "b", "h", "i", "s", "p", "e", "digits"), columns, strict=True)) | {"z": np.array(zones, dtype=object), "matched": np.array(matched, bool)}


def resolve(texts: Sequence[str], zone: str | None, order: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(day, has day, instant, has instant) of texts of one source: day on the source's clock, instant in UTC seconds."""
    c = components(texts)
    first = c["a"] >= 0
    if order in ("MDY", "DMY"):
        month, day = (c["a"], c["b"]) if order == "MDY" else (c["b"], c["a"])
        c["m"], c["d"] = np.where(first, month, c["m"]), np.where(first, day, c["d"])
    timed = c["h"] >= 0
    twelve = c["p"] >= 0
    hour = np.where(twelve, np.where((c["h"] >= 1) & (c["h"] <= 12), c["h"] % 12 + 12 * c["p"], 99), np.where(timed, c["h"], 0))
    right = (
        c["matched"] & (c["y"] >= 1) & (c["m"] >= 1) & (c["m"] <= 12) & (c["d"] >= 1) & (c["d"] <= month_days(c["y"], c["m"]))
        & (hour <= 23) & (c["i"] <= 59) & (c["s"] <= 59)
    )
    day = days_from_civil(np.where(right, c["y"], 1970), np.where(right, c["m"], 1), np.where(right, c["d"], 1))
    local = day * 86_400 + hour * 3_600 + c["i"] * 60 + c["s"]
    epoch = c["e"] >= 0
    unit = np.select([c["digits"] <= 11, c["digits"] <= 14, c["digits"] <= 17], [1, 1_000, 1_000_000], 1_000_000_000)
    shift, known = _shifts(c["z"], zone)
    zoned = c["z"] != ""
    instant, fixed = np.where(epoch, c["e"] // unit, local - shift), epoch | (right & zoned & known)
    showed = np.ones(len(local), bool)
    if zone is not None:
        own, showed = to_instant(local, zone)
        free = right & ~zoned & ~epoch
        instant, fixed = np.where(free, own, instant), fixed | (free & showed)
        own_day = to_local(instant, zone) // 86_400
        has_day = np.where(epoch | zoned, fixed, free & (showed | ~timed))
        return np.where(epoch | zoned, own_day, day), has_day, instant, fixed
    return day, right & ~zoned & ~timed, instant, fixed


def _shifts(zones: np.ndarray, zone: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(offset in seconds, whether known) of written zones; abbreviations are those of the source's zone."""
    names = {"Z": 0, "UTC": 0, "GMT": 0} | ({k: v for k, v in abbreviations(zone).items() if k not in ("UTC", "GMT")} if zone else {})
    table: dict[str, tuple[int, bool]] = {"": (0, False)}
    for z in set(zones):
        bare = re.sub(r"^(?:UTC|GMT)(?=[+-])", "", z)
        if m := re.fullmatch(r"([+-])(\d{2}):?(\d{2})?", bare):
            minutes = int(m[2]) * 60 + int(m[3] or 0)
            table[z] = (minutes * (-60 if m[1] == "-" else 60), minutes <= 18 * 60 and int(m[3] or 0) <= 59)
        else:
            table[z] = (names.get(bare, 0), bare in names)
    pairs = [table[z] for z in zones]
    return np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=bool)


def profiles(df: DataFrame) -> dict[str, tuple[str | None, str | None]]:
    """source -> (zone, date order), small by the bound that is checked here. Of several rows the least holds."""
    rows = df.select("table_name", "time_zone", "date_order").where("table_name is not null").distinct().limit(MAX_PROFILES + 1).collect()
    if len(rows) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} sources")
    best: dict[str, tuple[str | None, str | None]] = {}
    for r in sorted(rows, key=lambda r: tuple(str(x) for x in r)):
        best.setdefault(r.table_name, (r.time_zone, r.date_order))
    return best


def normal_texts(values: pd.Series, sources: pd.Series, day_wanted: pd.Series, known: dict[str, tuple[str | None, str | None]]) -> pd.Series:
    """Normal form of each text, see normalise(). Distinct texts of a source are read once."""
    frame = pd.DataFrame({"v": values.to_numpy(), "s": sources.to_numpy(), "w": day_wanted.to_numpy()})
    out = np.full(len(frame), UNRESOLVED, dtype=object)
    for source, part in frame.groupby("s", dropna=False, sort=False):
        zone, order = known.get(source, (None, None)) if isinstance(source, str) else (None, None)
        codes, texts = pd.factorize(part["v"])
        day, has_day, instant, fixed = resolve(texts, zone, order)
        days = day.astype("datetime64[D]").astype(str).astype(object)
        instants = (np.datetime_as_string(instant.astype("datetime64[s]")).astype(object)) + "Z"
        days, instants = np.where(has_day, days, UNRESOLVED), np.where(fixed, instants, UNRESOLVED)
        out[part.index] = np.where(part["w"], days[codes], instants[codes])
    return pd.Series(out)


def normalise(df: DataFrame, sources: DataFrame, *, day_fields: list[str], instant_fields: list[str], source: str = "table_name", keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """(keep..., field_name, value, normal_value) for every non-null value of the fields.

    sources: (table_name, time_zone, date_order). normal_value is yyyy-MM-dd for day fields, yyyy-MM-ddTHH:mm:ssZ for
    instant fields, or UNRESOLVED.
    """
    known = profiles(sources)

    @F.pandas_udf("string")
    def normal(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, origin, day_wanted in batches:
            yield normal_texts(values, origin, day_wanted, known)

    pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in (*day_fields, *instant_fields)))
    long = df.select(F.struct(*keep).alias("_keep"), F.col(source).alias("_source"), F.explode(pairs).alias("p")).select("_keep", "_source", "p.*").where("value is not null")
    read = normal.asNondeterministic()  # else a filter on the result would run it once more
    out = long.select("_keep", "field_name", "value", read("value", "_source", F.col("field_name").isin(*day_fields)).alias("normal_value"))
    return out.select("_keep.*", "field_name", "value", "normal_value")
