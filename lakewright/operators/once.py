"""Exactly one delivery of every message that was delivered at least once, over any number of batches and writers.

Identifiers are dictionary-encoded exactly: each belongs to a shard (by hash) and has a dense code within it. What was seen is a
bitmap per shard and bucket of 32,768 codes; Parquet's run-length and zstd coding keep the bitmaps compressed at rest. Both are
stored by shard, and a batch reads and rewrites only the shards that its identifiers fall into.

A batch goes through two commits. The first publishes codes for identifiers that have none; codes never change, and a code alone
says nothing about having been seen, so it is harmless if the batch ends there. The second selects one arrival for each identifier
whose bit is unset and unites the new bits with the old. Either commit holds only for the version of the state that
it was computed from: if another writer came first, its bits (or codes) are read and the selection is made anew. A batch that is retried after a
crash finds either none or all of its bits.

Skew: the arrivals of an identifier are never gathered. They are reduced to their least arrival before the shuffle, and dropped
arrivals are found by an anti-join on the arrival's own unique position, on which no key repeats.

Defined results: rows whose identifier is NULL take no part (neither kept nor dropped); arrivals in identical positions are one
arrival; an empty batch leaves codes and bits as they are; of two batches that hold the same unseen identifier, the one that commits
first keeps it; further columns pass through.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.session import stage
from lakewright.sources.versioned import ConflictError, Manifest

BITMAP_BITS = 32_768
STATE_SCHEMAS = {"dictionary": "shard int, id string, code bigint", "seen": "shard int, bucket bigint, bits binary"}
#: Identifiers of the first batch per shard, where the number of shards isn't given; it holds for the state's life.
IDS_PER_SHARD, MIN_SHARDS, MAX_SHARDS = 100_000, 8, 4_096
#: Folders a shard's dictionary may lie in before a batch that touches the shard writes it as one again.
DICTIONARY_PARTS = 16
#: Turns a commit takes against other writers before it gives up.
ATTEMPTS = 20


class SeenState:
    """The dictionary and bitmaps of everything that was delivered, in versions under ``path``.

    A version names, for every shard, the folders that hold its codes and the one that holds its bits.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None):
        self.spark, self.path, self._shards = spark, path.rstrip("/"), shards
        self.manifest = Manifest(spark, self.path)

    def snapshot(self) -> tuple[int, dict]:
        """(version, state) of the newest commit; version -1 before the first."""
        found = self.manifest.versions()
        return (found[-1], self.manifest.read(found[-1])) if found else (-1, {})

    def shards(self, state: dict, ids: DataFrame) -> int:
        """The number of shards, chosen once."""
        if "shards" in state:
            return state["shards"]
        return self._shards or min(MAX_SHARDS, max(MIN_SHARDS, ids.count() // IDS_PER_SHARD + 1))

    def read(self, part: str, state: dict | None = None, shards: Sequence[int] | None = None) -> DataFrame:
        """One part of a version (the newest by default), whole or of some shards only."""
        state = self.snapshot()[1] if state is None else state
        held = state.get(part, {})
        wanted = held if shards is None else [str(s) for s in shards if str(s) in held]
        files = [f"{self.path}/{folder}/s={s}" for s in wanted for folder in held[s]]
        empty = self.spark.createDataFrame([], STATE_SCHEMAS[part])
        return self.spark.read.schema(STATE_SCHEMAS[part]).parquet(*files) if files else empty

    def batches(self) -> set[str]:
        return set(self.snapshot()[1].get("batches", {}))

    def write(self, part: str, df: DataFrame) -> str:
        """Writes rows of a part, one folder per shard, and returns the folder's name."""
        name = f"{part}/{uuid.uuid4().hex}"
        rows = df.withColumn("s", F.col("shard")).repartition("shard")
        rows.write.option("compression", "zstd").partitionBy("s").parquet(f"{self.path}/{name}")
        return name


def encode(ids: DataFrame, held: DataFrame) -> DataFrame:
    """(shard, id, first, code, known) of identifiers: codes of the dictionary ``held``, and new ones behind them."""
    top = held.groupBy("shard").agg((F.max("code") + 1).alias("base"))  # one row per shard
    sharded = ids.join(held, ["shard", "id"], "left").join(F.broadcast(top), "shard", "left")
    order = Window.partitionBy("shard", F.col("code").isNull()).orderBy("id")
    fresh = F.coalesce("base", F.lit(0)) + F.row_number().over(order) - 1
    return sharded.select("shard", "id", "first", F.coalesce("code", fresh).cast("bigint").alias("code"), F.col("code").isNotNull().alias("known"))


def unseen(coded: DataFrame, seen: DataFrame) -> DataFrame:
    """The coded identifiers whose bit is not set, with bucket and position of the bit."""
    placed = coded.withColumn("bucket", F.bitmap_bucket_number("code")).withColumn("position", F.bitmap_bit_position("code"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(position div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.coalesce(F.expr("shiftright(byte, cast(position % 8 as int)) & 1") == 1, F.lit(False))
    return placed.join(seen, ["shard", "bucket"], "left").withColumn("byte", byte).where(~is_set).drop("bits", "byte")


class Batch:
    """One batch on its way into a state: ``prepare`` codes it and selects its arrivals, ``commit`` makes that hold.

    ``commit`` prepares again for as long as other writers commit between the two.
    """

    def __init__(self, arrivals: DataFrame, state: SeenState, *, identifier: str, position: Sequence[str], order: Sequence[str], batch: str | None = None):
        self.rows = arrivals.drop("keep").where(F.col(identifier).isNotNull())
        self.state, self.position, self.name = state, list(position), batch or uuid.uuid4().hex
        columns = list(dict.fromkeys([*order, *position]))
        self.ids = self.rows.groupBy(F.col(identifier).alias("id")).agg(F.min(F.struct(*columns)).alias("first"))
        self.coded: DataFrame | None = None
        self._selected: tuple[int, dict] | None = None
        self._hit: list[int] = []

    def _encode(self) -> None:
        """Give every identifier a code that is published in the dictionary."""
        ids, state = stage(self.ids, "once-ids"), self.state
        for turn in range(ATTEMPTS):
            version, now = state.snapshot()
            shards = state.shards(now, ids)
            sharded = ids.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
            self._hit = sorted(r.shard for r in sharded.select("shard").distinct().collect())  # at most MAX_SHARDS or the given number
            dictionary = state.read("dictionary", now, self._hit)
            coded = stage(encode(sharded, dictionary), "once-coded")
            fresh = coded.where("not known").select("shard", "id", "code")
            touched = {str(r.shard) for r in fresh.select("shard").distinct().collect()}
            if touched or "shards" not in now:
                held = dict(now.get("dictionary", {}))
                long = [s for s in touched if len(held.get(s, [])) >= DICTIONARY_PARTS]
                if long:
                    fresh = fresh.unionByName(state.read("dictionary", now, [int(s) for s in long]))
                name = state.write("dictionary", fresh)
                held |= {s: [name] if s in long else [*held.get(s, []), name] for s in touched}
                if not state.manifest.put(version + 1, now | {"shards": shards, "dictionary": held}):
                    time.sleep(0.02 * min(turn, 10))
                    continue
            self.coded = coded
            return
        raise ConflictError(f"{state.path}: {ATTEMPTS} attempts lost")

    def prepare(self) -> Batch:
        """Select the arrivals that the state, as it is now, hasn't seen, and write them and their bits; nothing holds yet."""
        version, now = self.state.snapshot()
        if self.name in now.get("batches", {}):
            return self
        if self.coded is None:
            self._encode()
            version, now = self.state.snapshot()
        chosen = unseen(self.coded, self.state.read("seen", now, self._hit))
        kept = f"kept/{uuid.uuid4().hex}"
        placed = chosen.select("shard", "bucket", "position", *(F.col(f"first.{c}").alias(f"_{c}") for c in self.position))
        placed.write.option("compression", "zstd").parquet(f"{self.state.path}/{kept}")
        new = self.state.spark.read.schema(placed.schema).parquet(f"{self.state.path}/{kept}")
        bits = new.groupBy("shard", "bucket").agg(F.bitmap_construct_agg("position").alias("bits"))
        touched = [r.shard for r in bits.select("shard").distinct().collect()]
        held = dict(now.get("seen", {}))
        if touched:
            both = bits.unionByName(self.state.read("seen", now, touched))
            name = self.state.write("seen", both.groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
            held |= {str(s): [name] for s in touched}
        self._selected = (version, now | {"seen": held, "batches": now.get("batches", {}) | {self.name: kept}})
        return self

    def commit(self) -> DataFrame:
        """The arrivals with ``keep``, once the state holds their bits."""
        for turn in range(ATTEMPTS):
            now = self.state.snapshot()[1]
            if self.name in now.get("batches", {}):
                return self._marked(now["batches"][self.name])
            if self._selected is None:
                self.prepare()
                continue
            version, new = self._selected
            self._selected = None
            if self.state.manifest.put(version + 1, new):
                return self._marked(new["batches"][self.name])
            time.sleep(0.02 * min(turn, 10))
        raise ConflictError(f"{self.state.path}: {ATTEMPTS} attempts lost")

    def _marked(self, folder: str) -> DataFrame:
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema.fields}
        schema = ", ".join(["shard int", "bucket bigint", "position bigint", *(f"`_{c}` {kinds[c]}" for c in self.position)])
        first = self.state.spark.read.schema(schema).parquet(f"{self.state.path}/{folder}")
        kept = first.select(*(F.col(f"_{c}").alias(c) for c in self.position), F.lit(True).alias("keep"))
        on = [F.col(f"a.{c}").eqNullSafe(F.col(f"k.{c}")) for c in self.position]
        joined = self.rows.alias("a").join(kept.distinct().alias("k"), on, "left")
        return joined.select("a.*", F.coalesce("k.keep", F.lit(False)).alias("keep"))


def keep_once(
    arrivals: DataFrame, state: SeenState, *, identifier: str, position: Sequence[str], order: Sequence[str], batch: str | None = None
) -> DataFrame:
    """Arrivals with ``keep``: true for one arrival per identifier that was unseen, and commits the new bits.

    position: columns that identify an arrival; order: columns by which the first arrival is chosen. ``batch`` names the batch;
    a batch that was committed already changes nothing in the state, and its kept arrivals are found again. ``arrivals``
    should be a scan.
    """
    return Batch(arrivals, state, identifier=identifier, position=position, order=order, batch=batch).prepare().commit()
