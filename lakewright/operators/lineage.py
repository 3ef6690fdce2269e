"""Which tables feed which, and how far a failure reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.failures import family
from lakewright.session import stage

# Weights and limits of the impact score.
LAYER_WEIGHTS = {"bronze": 1.0, "silver1": 2.0, "silver2": 3.0, "gold": 5.0}
LAYER_ORDER = tuple(LAYER_WEIGHTS)
SIDE_TABLES = ("silver1_dead_letter", "silver2_dead_letter", "silver2_quarantine", "silver2_fuzzy_audit", "ref_canonical_mappings")
OTHER_WEIGHT, REACH_HALF, ROWS_CAP = 0.5, 5.0, 10_000
SCORE_WEIGHTS = {"severity": 0.30, "reach": 0.25, "volume": 0.20, "propagation": 0.15, "blocks": 0.10}
SEVERITY = {
    "SCHEMA_MISMATCH": 1.0, "SCHEMA_DRIFT": 1.0, "MISSING_COLUMN": 1.0, "CORRUPT_RECORD": 0.9, "TYPE_MISMATCH": 0.8, "PARSE_ERROR": 0.7,
    "UNKNOWN": 0.6, "AMBIGUOUS_VALUE": 0.4, "UNRESOLVED_VALUE": 0.4,
}
MANDATORY_BONUS = 0.3
TIERS = (("P1", 70.0), ("P2", 40.0), ("P3", 0.0))
STATUSES = ("START", "RUNNING", "COMPLETE", "FAIL", "ABORT", "OTHER")
TERMINAL = ("COMPLETE", "FAIL", "ABORT")

EVENT = (
    "eventType string, eventTime string, job struct<namespace:string,name:string>, run struct<runId:string>, "
    "inputs array<struct<namespace:string,name:string>>, outputs array<struct<namespace:string,name:string,"
    "facets:struct<schema:struct<fields:array<struct<name:string,type:string>>>>>>"
)


def read_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Run events of JSON lines; lines that are none are left out, as are events without status, run, time or output."""
    e = lines.select(F.from_json(column, EVENT).alias("e")).select("e.*")
    return e.where(F.col("eventType").isin(*STATUSES) & F.expr("run.runId is not null and eventTime is not null and size(outputs) > 0"))


def tables_of(datasets: Column) -> Column:
    """Sorted distinct table names: the last part of each dataset's path."""
    return F.array_sort(F.array_distinct(F.transform(datasets, lambda d: F.element_at(F.split(d["name"], "/"), -1))))


def runs(events: DataFrame) -> DataFrame:
    """One row per run: a terminal status is never reopened, first start, last end."""
    order = F.struct(F.col("eventType").isin(*TERMINAL), "eventTime")
    return events.groupBy(F.col("run.runId").alias("run_id")).agg(
        F.max_by("eventType", order).alias("status"), F.min("eventTime").alias("started_at"),
        F.max(F.when(F.col("eventType").isin(*TERMINAL), F.col("eventTime"))).alias("ended_at"), F.max(F.concat(F.lit("write_"), tables_of(F.col("outputs"))[0])).alias("job"),
    )


def feeds(events: DataFrame) -> DataFrame:
    """(from_table, to_table): every input of a run with every output of it."""
    pairs = events.select(F.explode(tables_of(F.col("inputs"))).alias("from_table"), tables_of(F.col("outputs")).alias("out")).select("from_table", F.explode("out").alias("to_table"))
    return pairs.where("from_table <> to_table").distinct()


def schema_hash(fields: Column) -> Column:
    """First 16 hex digits of SHA-1 over the ordered name:type list."""
    return F.substring(F.sha1(F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.lit(":"), f["type"])), ",")), 1, 16)


def closure(edges: DataFrame) -> DataFrame:
    """(from_table, to_table, depth): everything downstream, at its least depth; a table is not downstream of itself but by an edge of its own.

    Reach doubles with every round: pairs within n steps, joined with themselves, are the pairs within 2n. Each pair is kept once, at its least depth,
    so that the work follows the number of pairs, not of paths, and cycles end. The rounds end when nothing changes.
    """
    known = stage(edges.select("from_table", "to_table").where("from_table is not null and to_table is not null").distinct().withColumn("depth", F.lit(1)), "lineage-edges")
    measure = lambda df: tuple(df.agg(F.count("*"), F.sum("depth")).first())
    size = measure(known)
    while True:
        a, b = known.alias("a"), known.alias("b")
        longer = a.join(b, F.col("a.to_table") == F.col("b.from_table")).where(F.col("a.from_table") != F.col("b.to_table"))
        longer = longer.select("a.from_table", "b.to_table", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        known = stage(known.unionByName(longer).groupBy("from_table", "to_table").agg(F.min("depth").alias("depth")), "lineage-reach")
        before, size = size, measure(known)
        if size == before:
            return known


def upstream(closed: DataFrame) -> DataFrame:
    """(table, upstream, depth) of a closure."""
    return closed.select(F.col("to_table").alias("table"), F.col("from_table").alias("upstream"), "depth")


def schema_versions(events: DataFrame) -> DataFrame:
    """(table, schema_hash, columns): the schema that the newest event of each table wrote; ties go to the greater hash."""
    written = events.select("eventTime", F.explode("outputs").alias("o")).where("o.facets.schema.fields is not null")
    fields = F.col("o.facets.schema.fields")
    rows = written.select("eventTime", F.element_at(F.split("o.name", "/"), -1).alias("table"), schema_hash(fields).alias("schema_hash"), F.transform(fields, lambda f: f["name"]).alias("columns"))
    return rows.groupBy("table").agg(F.max(F.struct("eventTime", "schema_hash", "columns")).alias("v")).select("table", "v.schema_hash", "v.columns")


def resolved(layer: Column, folder: Column, known: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Adds the table of a layer and folder: the folder's own if the graph knows it, else the layer's; and whether the graph knows it."""
    tables = known.select(F.col("table").alias("_t"), F.lit(True).alias("_known")).distinct()
    own = F.when(folder.isNotNull() & (F.trim(folder) != ""), F.concat(layer, F.lit("_"), F.lower(F.trim(folder))))
    rows = rows.withColumn("_own", own).withColumn("_layer", layer)
    for c in ("own", "layer"):
        rows = rows.join(tables.select(F.col("_t").alias(f"_{c}"), F.col("_known").alias(f"_{c}_known")), f"_{c}", "left")
    found = F.when(F.col("_own_known"), F.col("_own")).otherwise(F.col("_layer"))
    return rows.withColumn(name, found).withColumn(f"{name}_known", F.coalesce("_own_known", "_layer_known", F.lit(False))).drop("_own", "_layer", "_own_known", "_layer_known")


def reached(closed: DataFrame, schemas: DataFrame) -> DataFrame:
    """(from_table, to_table, depth, weight, columns): what is downstream, with the columns it holds as far as they are known; and the layers' own chain for tables without lineage."""
    chain = [(a, b, j - i) for i, a in enumerate(LAYER_ORDER) for j, b in enumerate(LAYER_ORDER) if j > i]
    rows = closed.join(schemas.select(F.col("table").alias("to_table"), "columns"), "to_table", "left")
    static = closed.sparkSession.createDataFrame(chain, "from_table string, to_table string, depth int").withColumn("columns", F.lit(None).cast("array<string>")).withColumn("static", F.lit(True))
    both = rows.withColumn("static", F.lit(False)).select("from_table", "to_table", F.col("depth").cast("int").alias("depth"), "columns", "static").unionByName(static)
    return both.withColumn("weight", layer_weight(F.col("to_table")))


def impact_by_lineage(failures: DataFrame, edges: DataFrame, schemas: DataFrame) -> DataFrame:
    """As impact(), from lineage events: origin tables are resolved against the graph, those it doesn't know fall back to the chain of layers
    (``lineage_known`` false), and a value failure propagates fully, not at all, or by half as its column is held by a consumer, by none of
    those whose schema is known, or nothing is known. failures has origin_layer and folder.
    """
    known = edges.select(F.col("from_table").alias("table")).union(edges.select("to_table"))
    rows = resolved(F.col("origin_layer"), F.col("folder"), known, failures, "origin_table").withColumnRenamed("origin_table_known", "lineage_known")
    down = stage(reached(closure(edges), schemas), "lineage-down")
    sums = down.groupBy(F.col("from_table").alias("origin_table"), "static").agg(F.sum("weight").alias("downstream"))
    rows = rows.withColumn("static", ~F.col("lineage_known")).join(sums, ["origin_table", "static"], "left")
    held = down.where("weight > 0 and columns is not null")
    columns = held.select(F.col("from_table").alias("origin_table"), "static", F.explode("columns").alias("column_name")).distinct().withColumn("_holds", F.lit(True))
    rows = rows.join(columns, ["origin_table", "static", "column_name"], "left").join(held.select(F.col("from_table").alias("origin_table"), "static", F.lit(True).alias("_told")).distinct(), ["origin_table", "static"], "left")
    own = F.when(F.coalesce("origin_affected", F.lit(False)), layer_weight(F.col("origin_table"))).otherwise(0.0)
    counts = rows.groupBy(F.col("origin_table").alias("to_table")).agg(F.count("*").alias("there"))
    below = down.where("not static").join(counts, "to_table").groupBy(F.col("from_table").alias("origin_table")).agg(F.sum("there").alias("blocked"))
    rows = rows.join(below, "origin_table", "left").withColumn("reach", F.coalesce("downstream", F.lit(0.0)) + own).withColumn("blocked", F.coalesce("blocked", F.lit(0)))
    spread = F.when(_record_wide(), 1.0).when(F.col("_holds"), 1.0).when(F.col("_told"), 0.0).otherwise(0.5)
    return _scored(rows.withColumn("propagation", spread)).drop("downstream", "static", "_holds", "_told")


def layer_weight(table: Column) -> Column:
    """Weight of a table by the longest layer name that begins it; side tables weigh nothing."""
    starts = lambda n: (table == n) | table.startswith(n + "_") | table.startswith(n + ".")
    rules = [(n, 0.0) for n in SIDE_TABLES] + sorted(LAYER_WEIGHTS.items(), key=lambda x: -len(x[0]))
    return F.coalesce(*(F.when(starts(n), F.lit(w)) for n, w in rules), F.lit(OTHER_WEIGHT))


def severity() -> Column:
    base = F.coalesce(*(F.when(F.upper("failure_type") == k, F.lit(v)) for k, v in SEVERITY.items()), F.lit(SEVERITY["UNKNOWN"]))
    return F.when(F.coalesce("origin_affected", F.lit(False)), 1.0).otherwise(F.least(F.lit(1.0), base + F.when(F.coalesce("mandatory", F.lit(False)), MANDATORY_BONUS).otherwise(0.0)))


def volume(rows: Column) -> Column:
    import math

    return F.when(rows.isNull(), 0.5).when(rows <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log10(rows + 1) / math.log10(1 + ROWS_CAP)))


def impact(failures: DataFrame, edges: DataFrame) -> DataFrame:
    """Score (0 to 100) and tier of each failure from severity, reach, volume, propagation and the failures it blocks.

    failures has origin_table (``<layer>_<folder>``) besides the columns of a report; ``edges`` is a graph of tables.
    """
    down = closure(edges).withColumn("weight", layer_weight(F.col("to_table")))
    reach = down.groupBy(F.col("from_table").alias("origin_table")).agg(F.sum("weight").alias("downstream"), F.collect_set("to_table").alias("affected"))
    rows = failures.join(reach, "origin_table", "left")
    own = F.when(F.coalesce("origin_affected", F.lit(False)), layer_weight(F.col("origin_table"))).otherwise(0.0)
    counts = failures.groupBy("origin_table").agg(F.count("*").alias("there"))
    below = down.join(counts, down["to_table"] == counts["origin_table"]).groupBy(F.col("from_table").alias("origin_table")).agg(F.sum("there").alias("blocked"))
    rows = rows.join(below, "origin_table", "left").withColumn("reach", F.coalesce("downstream", F.lit(0.0)) + own).withColumn("blocked", F.coalesce("blocked", F.lit(0)))
    spread = F.when(_record_wide(), 1.0).otherwise(0.5)
    return _scored(rows.withColumn("propagation", spread)).drop("downstream", "affected", "propagation")


def _record_wide() -> Column:
    return family(F.col("failure_type")).isin("SCHEMA", "RECORD") | F.coalesce("origin_affected", F.lit(False)) | F.col("column_name").isNull()


def _scored(rows: DataFrame) -> DataFrame:
    """Adds score and tier to rows with reach, propagation and blocked."""
    factors = {
        "severity": severity(), "reach": F.when(F.col("reach") > 0, F.col("reach") / (F.col("reach") + REACH_HALF)).otherwise(0.0),
        "volume": volume(F.col("rows_affected")), "propagation": F.col("propagation"), "blocks": F.col("blocked") / (F.col("blocked") + 1.0),
    }
    total = sum((factors[k] * (100 * w) for k, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    rows = rows.withColumn("_total", total)
    tier = F.coalesce(*(F.when(F.col("_total") >= least, F.lit(name)) for name, least in TIERS))
    return rows.withColumn("score", F.round("_total", 1)).withColumn("tier", tier).drop("_total")
