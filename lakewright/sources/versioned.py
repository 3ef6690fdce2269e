"""Versioned tables on plain files: atomic commits, snapshots, idempotent appends, updates, compaction.

A commit is one small JSON file whose name is its version, created with a no-overwrite rename through the file system API of
Hadoop; of two writers one wins and the other retries on the newer state. Data files are immutable folders of Parquet.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Turns a commit takes against other writers before it gives up.
ATTEMPTS = 20


class ConflictError(RuntimeError):
    """Another writer committed first, again and again."""


class Manifest:
    """A numbered sequence of JSON states under ``path``/_log; ``commit`` adds the next one atomically."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, f"{path.rstrip('/')}/_log"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.log).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path(self.log)
        if not self._fs.exists(at):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.log}/{version:012d}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict:
        found = self.versions()
        return self.read(found[-1]) if found else {}

    def put(self, version: int, state: dict) -> bool:
        """Create the file of ``version``; False if another writer has it already."""
        target = self._path(f"{self.log}/{version:012d}.json")
        if self._fs.exists(target):
            return False
        draft = self._path(f"{self.log}/.{version}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, options)  # fails if the target exists
        except Exception:
            self._fs.delete(draft, False)
            if self._fs.exists(target):
                return False
            raise
        return True

    def commit(self, change: Callable[[dict], dict], attempts: int = ATTEMPTS) -> int:
        """Apply ``change`` to the current state and store the result as the next version."""
        for turn in range(attempts):
            found = self.versions()
            version = found[-1] + 1 if found else 0
            if self.put(version, change(self.read(found[-1]) if found else {})):
                return version
            time.sleep(0.05 * min(turn, 10))
        raise ConflictError(f"{self.log}: {attempts} attempts lost")


class VersionedTable:
    """A table with snapshots. Reads see one version; a writer's files appear only with its commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, self.path)

    # -- reading

    def exists(self) -> bool:
        return bool(self.manifest.versions())

    def version(self) -> int:
        found = self.manifest.versions()
        if not found:
            raise FileNotFoundError(f"{self.path} has no commit")
        return found[-1]

    def state(self, version: int | None = None) -> dict:
        return self.manifest.read(self.version() if version is None else version)

    def schema(self, version: int | None = None) -> T.StructType:
        return T.StructType.fromJson(self.state(version)["schema"])

    def read(self, version: int | None = None) -> DataFrame:
        """Snapshot of a version (the newest by default); columns that older files lack are NULL."""
        state = self.state(version)
        schema = T.StructType.fromJson(state["schema"])
        files = [f"{self.path}/{x}" for x in state["files"]]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def history(self) -> list[dict]:
        """Newest first: version, operation, time, rows of files added and removed."""
        return [{"version": v} | self.manifest.read(v)["info"] for v in reversed(self.manifest.versions())]

    # -- writing

    def _write(self, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    @staticmethod
    def _merged(old: T.StructType | None, new: T.StructType, *, evolve: bool) -> T.StructType:
        """Union by name; a type may not change, and new columns need ``evolve``."""
        if old is None:
            return T.StructType([T.StructField(f.name, f.dataType, True) for f in new.fields])
        held = {f.name: f for f in old.fields}
        for f in new.fields:
            if f.name in held and held[f.name].dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"{f.name}: {held[f.name].dataType.simpleString()} can't take {f.dataType.simpleString()}")
        added = [T.StructField(f.name, f.dataType, True) for f in new.fields if f.name not in held]
        if added and not evolve:
            raise ValueError(f"new columns {[f.name for f in added]}")
        return T.StructType([*old.fields, *added])

    def append(self, df: DataFrame, *, app_id: str | None = None, batch: int | None = None, evolve: bool = False) -> bool:
        """Add rows. With ``app_id`` and ``batch`` a batch that was taken already is skipped and False is returned."""
        if app_id is not None and self.exists() and self.state()["applied"].get(app_id, -1) >= batch:
            return False
        schema, name, done = df.schema, self._write(df), []

        def change(now: dict) -> dict:
            done.clear()
            applied = dict(now.get("applied", {}))
            if app_id is not None and applied.get(app_id, -1) >= batch:
                return now | {"info": self._info("skipped")}
            if app_id is not None:
                applied[app_id] = batch
            old = T.StructType.fromJson(now["schema"]) if now else None
            done.append(True)
            return {
                "schema": self._merged(old, schema, evolve=evolve).jsonValue(), "files": [*now.get("files", []), name], "applied": applied,
                "info": self._info("append", added=1) | {"files": [name]},
            }

        self.manifest.commit(change)
        return bool(done)

    def overwrite(self, df: DataFrame) -> None:
        """Replace rows and schema in one commit."""
        schema, name = self._merged(None, df.schema, evolve=True).jsonValue(), self._write(df)
        self.manifest.commit(lambda now: {"schema": schema, "files": [name], "applied": now.get("applied", {}), "info": self._info("overwrite", added=1, removed=len(now.get("files", [])))})

    def add_columns(self, ddl: str) -> None:
        """Add columns that are missing; existing rows have NULL there."""
        extra = T._parse_datatype_string(ddl)
        known = set(self.schema().fieldNames())
        extra = T.StructType([f for f in extra.fields if f.name not in known])
        if extra.fields:
            self.manifest.commit(lambda now: now | {"schema": self._merged(T.StructType.fromJson(now["schema"]), extra, evolve=True).jsonValue(), "info": self._info("add columns")})

    def update(self, where: Column, values: dict[str, Column]) -> int:
        """Set columns of the rows that match; rewrites only the files that hold such rows. Returns the number of rows."""
        return self._rewrite("update", where, values)

    def delete(self, where: Column) -> int:
        """Remove the rows that match."""
        return self._rewrite("delete", where, None)

    def _rewrite(self, kind: str, where: Column | None, values: dict[str, Column] | None, keys: DataFrame | None = None) -> int:
        """Rewrite the files that hold matching rows: of ``where``, and, with ``keys``, of those whose key columns occur there."""
        for turn in range(ATTEMPTS):
            version = self.version()
            state, schema = self.state(version), self.schema(version)
            if not state["files"]:
                return 0
            match = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
            rows = self.read(version)
            if keys is not None:
                on = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in keys.columns]
                rows = rows.withColumn("_file", F.col("_metadata.file_path")).alias("r").join(keys.distinct().withColumn("_hit", F.lit(True)).alias("k"), on, "left").select("r.*", "k._hit")
                match = match & F.coalesce("_hit", F.lit(False))
            else:
                rows = rows.withColumn("_file", F.col("_metadata.file_path"))
            folder = F.regexp_extract("_file", "/(data/[0-9a-f]{32})/", 1)
            hits = {r.f: r.n for r in rows.where(match).groupBy(folder.alias("f")).agg(F.count("*").alias("n")).collect()}  # one row per folder
            touched, total = [x for x in state["files"] if x in hits], sum(hits.values())
            if not touched:
                return 0
            rows = rows.where(folder.isin(*touched))
            if values is None:
                changed = rows.where(~match).select(*schema.fieldNames())
            else:
                changed = rows.select(*(F.when(match, values[c].cast(schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in schema.fieldNames()))
            name = self._write(changed)
            new = state | {"files": [*(x for x in state["files"] if x not in touched), name], "info": self._info(kind, added=1, removed=len(touched), rows=total)}
            if self.manifest.put(version + 1, new):
                return total
            time.sleep(0.05 * min(turn, 10))
        raise ConflictError(self.path)

    def update_matching(self, keys: DataFrame, values: dict[str, Column], where: Column | None = None) -> int:
        """Set columns of the rows whose key columns, those of ``keys``, occur in it, and that match ``where``. Returns the number of rows."""
        return self._rewrite("update", where, values, keys)

    def merge_missing(self, df: DataFrame, keys: list[str]) -> int:
        """Insert rows of ``df`` whose keys the table has not; NULL keys compare equal. Returns the number inserted.

        The commit holds only for the version that was compared with: of two writers with the same key one inserts it.
        """
        for turn in range(ATTEMPTS):
            found = self.manifest.versions()
            now = self.manifest.read(found[-1]) if found else {}
            new = df.dropDuplicates(keys)
            if now:
                on = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
                new = new.alias("n").join(self.read(found[-1]).alias("o"), on, "left_anti")
            name = self._write(new)
            n = self.spark.read.schema(new.schema).parquet(f"{self.path}/{name}").count()
            if not n and now:
                return 0
            schema = self._merged(T.StructType.fromJson(now["schema"]) if now else None, df.schema, evolve=False).jsonValue()
            state = {"schema": schema, "files": [*now.get("files", []), name], "applied": now.get("applied", {}), "info": self._info("append", added=1) | {"files": [name]}}
            if self.manifest.put(found[-1] + 1 if found else 0, state):
                return n
            time.sleep(0.05 * min(turn, 10))
        raise ConflictError(self.path)

    # -- upkeep

    def size(self, version: int | None = None) -> int:
        """Bytes of the files of a version."""
        fs, path = self.manifest._fs, self.manifest._path
        return sum(fs.getContentSummary(path(f"{self.path}/{x}")).getLength() for x in self.state(version)["files"])

    def compact(self, files: int | None = None, *, bytes_per_file: int = 512_000_000) -> None:
        """Rewrite the snapshot into one folder of ``files`` files, by default as many as its size needs; no row changes. Made anew if another writer commits first."""
        for turn in range(ATTEMPTS):
            version = self.version()
            state = self.state(version)
            number = files or max(1, -(-self.size(version) // bytes_per_file))
            name = self._write(self.read(version).repartition(number) if number > 1 else self.read(version).coalesce(1))
            if self.manifest.put(version + 1, state | {"files": [name], "info": self._info("compact", added=1, removed=len(state["files"]))}):
                return
            time.sleep(0.05 * min(turn, 10))
        raise ConflictError(self.path)

    def vacuum(self, keep_versions: int = 1, *, retain_seconds: float = 0.0) -> list[str]:
        """Delete data folders that none of the kept versions uses, and the other versions' files. Kept are the newest ``keep_versions`` and all younger than ``retain_seconds``."""
        found = self.manifest.versions()
        young = time.time() - retain_seconds
        first = next((k for k, v in enumerate(found) if retain_seconds and self.manifest.read(v)["info"]["at"] >= young), len(found))
        first = min(first, max(0, len(found) - keep_versions))
        kept, old = found[first:], found[:first]
        used = {x for v in kept for x in self.manifest.read(v)["files"]}
        gone = sorted({x for v in old for x in self.manifest.read(v)["files"]} - used)
        fs, path = self.manifest._fs, self.manifest._path
        for name in gone:
            fs.delete(path(f"{self.path}/{name}"), True)
        for v in old:
            fs.delete(path(f"{self.manifest.log}/{v:012d}.json"), False)
        return gone

    @staticmethod
    def _info(operation: str, **more: int) -> dict:
        return {"operation": operation, "at": time.time(), **more}


def readable(spark: SparkSession, path: str) -> bool:
    """Whether a table has been committed at ``path``."""
    try:
        return VersionedTable(spark, path).exists()
    except AnalysisException:
        return False


def wait_for(table: VersionedTable, *, timeout: float, poll: float = 0.2, upstream_ok: Callable[[], bool] = lambda: True) -> None:
    """Block until the table has a commit; fails when the time is over or its writer has died."""
    end = time.monotonic() + timeout
    while not table.exists():
        if not upstream_ok():
            raise RuntimeError(f"{table.path}: its writer ended without a commit")
        if time.monotonic() > end:
            raise TimeoutError(table.path)
        time.sleep(poll)
