"""Per-period counts by event time, corrected as late records arrive, with a cut-off for lateness.

State is a table of conflict-free counters keyed by (period, source). A counter knows when it came into being (``born``, the
first arrival of its period), the last arrival it counted, its number of records and the version of the state that changed it. Counters
merge per period and source: the least ``born``, and of the counts the one with the greater version, never a sum; a period's total
is the sum over its sources. Batches are named: one that was applied already changes nothing, and their order doesn't matter.

Lateness is read off the counters without ordering all records of a source in one place: the latest period seen before instant ``t`` is at
least ``d + k`` exactly when the counter of some period from ``d + k`` on was born before ``t``, and that is a suffix minimum over the
counters, whose number is bounded by sources x days and does not grow with the records.

Defined results: rows without id, source, period or arrival time take no part; exact repeats and re-sent rows count once, at the
earliest arrival (ties: earliest period, then source), whichever batch brings it; an empty table gives empty results; further columns are ignored.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.session import small, stage
from lakewright.sources.versioned import ConflictError, Manifest

#: Counters up to which limits are broadcast; beyond it they are joined by shuffle.
BROADCAST_PERIODS = 500_000
ATTEMPTS = 20

ARRIVALS = "record_id string, source string, day int, arrived bigint, gone boolean"
COUNTERS = "source string, day int, born bigint, last bigint, version bigint, n bigint"
PAIR = ["source", "day"]


def first_arrivals(df: DataFrame, *, record_id: str, source: str, period: str, arrived: str) -> DataFrame:
    """(record_id, source, day, arrived) with one row per record: its first arrival. day counts from 1970, arrived in µs."""
    day = F.datediff(F.col(period).try_cast("date"), F.lit("1970-01-01").cast("date"))
    micros = F.unix_micros(F.col(arrived).try_cast("timestamp"))
    rows = df.select(F.col(record_id).cast("string").alias("record_id"), F.struct(micros.alias("arrived"), day.alias("day"), F.col(source).alias("source")).alias("a"))
    rows = rows.where("record_id is not null and a.arrived is not null and a.day is not null and a.source is not null")
    return rows.groupBy("record_id").agg(F.min("a").alias("a")).select("record_id", "a.source", "a.day", "a.arrived")


def births(arrivals: DataFrame) -> DataFrame:
    """(source, day, born): when the counter of a source's period came into being. Merges by minimum."""
    return arrivals.groupBy(*PAIR).agg(F.min("arrived").alias("born"))


def limits(counters: DataFrame, corrects_days: int, cutoff_days: int) -> DataFrame:
    """(source, day, late_at, closed_at): from when on a record of the day corrects an older count, and is too late."""
    ahead = lambda days: Window.partitionBy("source").orderBy("day").rangeBetween(days, Window.unboundedFollowing)
    return counters.select(*PAIR, F.min("born").over(ahead(corrects_days)).alias("late_at"), F.min("born").over(ahead(cutoff_days + 1)).alias("closed_at"))


def in_time() -> Column:
    """Whether an arrival with the limits of its period is counted."""
    return ~F.coalesce(F.col("closed_at") < F.col("arrived"), F.lit(False))


def with_limits(arrivals: DataFrame, bounds: DataFrame) -> DataFrame:
    return arrivals.join(F.broadcast(bounds) if small(bounds, BROADCAST_PERIODS) else bounds, PAIR, "left")


def with_outcome(arrivals: DataFrame, bounds: DataFrame) -> DataFrame:
    """Arrivals with outcome: ``on_time``, ``corrects`` or ``too_late``."""
    outcome = F.when(~in_time(), "too_late").when(F.col("late_at") < F.col("arrived"), "corrects").otherwise("on_time")
    return with_limits(arrivals, bounds).select("record_id", "source", "day", "arrived", outcome.alias("outcome"))


def classify(df: DataFrame, *, record_id: str, source: str, period: str, arrived: str, corrects_days: int = 2, cutoff_days: int = 14) -> DataFrame:
    """Outcome of every record's first arrival: (record_id, source, day, arrived, outcome)."""
    arrivals = stage(first_arrivals(df, record_id=record_id, source=source, period=period, arrived=arrived), "late-arrivals")
    return with_outcome(arrivals, limits(stage(births(arrivals), "late-births"), corrects_days, cutoff_days))


def counted(outcomes: DataFrame, version: int = 0) -> DataFrame:
    """(source, day, last, version, n): the counters of classified arrivals. Records that are too late are left out."""
    taken = outcomes.where("outcome <> 'too_late'").groupBy(*PAIR)
    return taken.agg(F.max("arrived").alias("last"), F.lit(version).cast("bigint").alias("version"), F.count("*").alias("n"))


def merge(*states: DataFrame) -> DataFrame:
    """Join of counters of one state's versions: per period and source the greatest version. Idempotent and order-free."""
    both = states[0].select(*PAIR, "last", "version", "n")
    for s in states[1:]:
        both = both.unionByName(s.select(*PAIR, "last", "version", "n"))
    return both.groupBy(*PAIR).agg(F.max(F.struct("version", "n", "last")).alias("c")).select(*PAIR, "c.last", "c.version", "c.n")


def period_totals(counters: DataFrame) -> DataFrame:
    """(day, sources, n): sum of the sources' merged counters per period."""
    return merge(counters).where("n > 0").groupBy("day").agg(F.count("*").alias("sources"), F.sum("n").alias("n"))


def day_text(day: Column) -> Column:
    """yyyy-MM-dd of a day number."""
    return F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string")


class LateState:
    """Counters that are kept under ``path`` and corrected batch by batch.

    Beside the counters it holds the first arrival of every record, by shards of record ids, because only they tell whether a record is new
    and what a period counts again when its limit moves. A batch reads the shards its ids fall into; periods whose limit
    moved past arrivals that were counted, and those that a record left for an earlier arrival, are counted again from their arrivals; all others
    only grow. A commit holds only for the version it was computed from; after a conflict the batch is computed again.
    """

    def __init__(self, spark: SparkSession, path: str, *, corrects_days: int = 2, cutoff_days: int = 14, shards: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.corrects_days, self.cutoff_days, self.shards = corrects_days, cutoff_days, shards
        self.manifest = Manifest(spark, self.path)

    def snapshot(self) -> tuple[int, dict]:
        found = self.manifest.versions()
        return (found[-1], self.manifest.read(found[-1])) if found else (-1, {"applied": [], "arrivals": {}, "counters": None})

    def _arrivals(self, state: dict, shards: list[int] | None = None) -> DataFrame:
        held = state["arrivals"]
        files = [f"{self.path}/{x}/s={s}" for s in (held if shards is None else map(str, shards)) for x in held.get(s, [])]
        return self.spark.read.schema(ARRIVALS).parquet(*files) if files else self.spark.createDataFrame([], ARRIVALS)

    def _counters(self, state: dict) -> DataFrame:
        return self.spark.read.schema(COUNTERS).parquet(f"{self.path}/{state['counters']}") if state["counters"] else self.spark.createDataFrame([], COUNTERS)

    def arrivals(self) -> DataFrame:
        """The first arrival of every record."""
        return _standing(self._arrivals(self.snapshot()[1]))

    def counters(self) -> DataFrame:
        """(source, day, born, last, version, n)."""
        return self._counters(self.snapshot()[1])

    def outcomes(self) -> DataFrame:
        """Every record with its outcome as of now."""
        return with_outcome(self.arrivals(), limits(self.counters(), self.corrects_days, self.cutoff_days))

    def apply(self, df: DataFrame, batch: str, *, record_id: str, source: str, period: str, arrived: str) -> bool:
        """Take in a batch of rows; False if a batch of that name was applied before."""
        return self.absorb(first_arrivals(df, record_id=record_id, source=source, period=period, arrived=arrived), batch)

    def absorb(self, arrivals: DataFrame, batch: str) -> bool:
        """Take in first arrivals (record_id, source, day, arrived), of a batch or of another state."""
        if batch in self.snapshot()[1]["applied"]:
            return False
        came = stage(arrivals.withColumn("s", F.pmod(F.xxhash64("record_id"), F.lit(self.shards)).cast("int")), "late-batch")
        for turn in range(ATTEMPTS):
            version, now = self.snapshot()
            if batch in now["applied"]:
                return False
            if self.manifest.put(version + 1, self._next(came, now, version + 1) | {"applied": [*now["applied"], batch]}):
                return True
            time.sleep(0.02 * min(turn, 10))
        raise ConflictError(f"{self.path}: {ATTEMPTS} attempts lost")

    def _next(self, came: DataFrame, now: dict, version: int) -> dict:
        hit = sorted(r.s for r in came.select("s").distinct().collect())  # at most the number of shards
        known = self._arrivals(now, hit).groupBy("record_id").agg(F.min(F.struct("arrived", "day", "source")).alias("old"))
        rows = came.select("record_id", "s", F.struct("arrived", "day", "source").alias("new")).join(known, "record_id", "left")
        news = stage(rows.where("old is null or new < old"), "late-news")
        old, new = self._counters(now), news.select("record_id", "s", "new.*", F.lit(False).alias("gone"))
        left = news.where("old is not null").select("record_id", "s", "old.*", F.lit(True).alias("gone"))
        part = f"arrivals/{uuid.uuid4().hex}"
        columns = ["record_id", "source", "day", "arrived", "gone", "s"]
        new.unionByName(left).select(*columns).repartition("s").sortWithinPartitions("s", "day").write.option("compression", "zstd").partitionBy("s").parquet(f"{self.path}/{part}")
        held = {str(s): [*now["arrivals"].get(str(s), []), part] for s in (r.s for r in news.select("s").distinct().collect())}
        then = now | {"arrivals": now["arrivals"] | held}

        # when each counter was born: lesser by new arrivals, found anew where a record left
        gone = stage(left.select(*PAIR).distinct(), "late-left")
        some_left = not gone.isEmpty()
        born = old.select(*PAIR, "born").unionByName(births(new))
        if some_left:
            born = born.join(gone, PAIR, "left_anti").unionByName(births(self._of_pairs(then, gone)))
        born = stage(born.groupBy(*PAIR).agg(F.min("born").alias("born")), "late-born")
        before = limits(old, self.corrects_days, self.cutoff_days).select(*PAIR, F.col("closed_at").alias("was_closed_at"))
        after = stage(limits(born, self.corrects_days, self.cutoff_days).join(born, PAIR).join(before, PAIR, "left").join(old.drop("born"), PAIR, "left"), "late-limits")

        moved = F.coalesce(F.col("closed_at") < F.col("last"), F.lit(False)) | (F.col("was_closed_at").isNotNull() & F.coalesce(F.col("closed_at") > F.col("was_closed_at"), F.col("closed_at").isNull()))
        again = after.where(moved).select(*PAIR)
        again = stage((again.unionByName(gone) if some_left else again).distinct(), "late-again")
        total = lambda d: d.join(after.select(*PAIR, "closed_at"), PAIR).where(in_time()).groupBy(*PAIR).agg(F.count("*").alias("more"), F.max("arrived").alias("latest"))
        grown = after.join(again, PAIR, "left_anti").join(total(new), PAIR, "left").withColumn("base", F.coalesce("n", F.lit(0)))
        if not again.isEmpty():
            redone = after.join(again, PAIR, "left_semi").join(total(self._of_pairs(then, again)), PAIR, "left")
            grown = grown.unionByName(redone.withColumn("base", F.lit(0)).withColumn("last", F.lit(None).cast("bigint")).withColumn("n", F.lit(-1).cast("bigint")))
        n = F.col("base") + F.coalesce("more", F.lit(0))
        same = F.col("version").isNotNull() & (F.col("n") == n)
        counters = grown.select(*PAIR, "born", F.greatest("last", "latest").alias("last"), F.when(same, F.col("version")).otherwise(F.lit(version)).cast("bigint").alias("version"), n.cast("bigint").alias("n"))
        name = f"counters/{uuid.uuid4().hex}"
        counters.coalesce(8).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return then | {"counters": name}

    def _of_pairs(self, state: dict, pairs: DataFrame) -> DataFrame:
        """The standing arrivals of some (source, day); only files that hold such days are read."""
        low, high = pairs.agg(F.min("day"), F.max("day")).first()
        rows = self._arrivals(state).where(F.col("day").between(low, high))
        return _standing(rows.join(F.broadcast(pairs) if small(pairs, BROADCAST_PERIODS) else pairs, PAIR, "left_semi"))


def _standing(rows: DataFrame) -> DataFrame:
    """Arrivals that no earlier one has replaced."""
    key = ["record_id", "source", "day", "arrived"]
    return rows.groupBy(*key).agg(F.max("gone").alias("gone")).where("not gone").select(*key)
