"""Queries of the layered pipeline's own operators, each with SQL of the same result where SQL can express it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.functions.distance import damerau_column
from lakewright.operators import clean, contract, drift, failures, faults, gold, incidents, inspect, lineage, replay, standardize
from lakewright.session import stage
from lakewright.sources.tables import table
from lakewright.vocab import CRASH_COLUMNS

SHOWN = ("traffic_control_device", "weather_condition", "hit_and_run_i", "prim_contributory_cause", "street_name", "crash_month", "damage")
POSITION = ("topic", "kafka_partition", "kafka_offset")
RENAME = {"WeatherCondition": "weather_condition", "clock_hour": "crash_hour", "src_latitude": "latitude"}


# -- sources, cleaning, contract


def clean_projection(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean(clean.unpack(table(spark, d, "bronze_crashes"), POSITION)).select(*POSITION, *SHOWN)


def union_sources_tagged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "silver2_crashes")
    union = gold.union_sources({s: rows.where(F.col("table_name") == s).drop("dooring_i" if s == "Crash2" else "") for s in ("Crash1", "Crash2", "Crash3", "Crash4")})
    return union.groupBy("source_table").agg(F.count("*").alias("records"), F.count("dooring_i").alias("dooring"))


def contract_guard(spark: SparkSession, d: str) -> DataFrame:
    checked = contract.check(table(spark, d, "bronze_crashes")).where("error_class is not null")
    return checked.select(*POSITION, "error_class", F.array_join("expected_only", ",").alias("expected_only"), F.array_join("source_only", ",").alias("source_only"))


def contract_signatures(spark: SparkSession, d: str) -> DataFrame:
    return contract.signatures(contract.check(table(spark, d, "bronze_crashes")))


def dead_letter_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "silver1_dead_letter")
    keys = ("source_table", "stage", "error_class", "healing_status")
    return rows.groupBy(*keys).agg(F.count("*").alias("records"), F.count_distinct("silver1_batch_id").alias("batches"))


# -- standardizing


def mapping_latest(spark: SparkSession, d: str) -> DataFrame:
    return standardize.latest_mappings(table(spark, d, "ref_canonical_mappings"))


def map_lookup_exact(spark: SparkSession, d: str) -> DataFrame:
    known = F.broadcast(mapping_latest(spark, d).where("field_name = 'weather_condition'"))  # a list of fixed size
    rows = table(spark, d, "silver1_crashes").groupBy(F.upper(F.trim("weather_condition")).alias("spelling")).agg(F.count("*").alias("records"))
    return rows.join(known, "spelling", "left").select("spelling", "records", "canonical_value")


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    days = F.broadcast(table(spark, d, "source_profiles").select("table_name", (F.col("date_order") == "DMY").alias("day_first")))  # one row per source
    return table(spark, d, "silver1_crashes").join(days, "table_name", "left").withColumn("day_first", F.coalesce("day_first", F.lit(False)))


def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = _ordered(spark, d).where("crash_date is not null").select("crash_date", "day_first").distinct()
    return rows.withColumn("standard", standardize.standard_date(F.col("crash_date"), F.col("day_first")))


def parse_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "silver1_crashes").select("posted_speed_limit", "num_units").distinct()
    none = F.lit(None).cast("string")
    return rows.select("posted_speed_limit", "num_units", standardize.standard_speed(F.col("posted_speed_limit")).alias("speed"), standardize.standard_units(F.col("num_units"), none).cast("double").alias("units"))


def parse_hours(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "silver1_crashes").select("crash_hour").distinct()
    return rows.select("crash_hour", standardize.standard_hour(F.col("crash_hour"), F.lit(None).cast("string")).alias("standard"))


def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "silver1_crashes").select(F.upper(F.trim("crash_month")).alias("a")).where("a is not null").distinct()
    return names.select("a", damerau_column(F.col("a"), F.lit("SEPTEMBER")).alias("distance"))


def fuzzy_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _fuzzy(spark, d).select("field_name", "value", "canonical")


def fuzzy_audit(spark: SparkSession, d: str) -> DataFrame:
    return _fuzzy(spark, d).where("canonical is not null").select("field_name", "value", "canonical", "distance")


def _fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Guarded match of the distinct values that no exact spelling resolves."""
    ref = table(spark, d, "ref_canonical_mappings")
    of, known = standardize.anchors(ref), standardize.mapping_dict(ref)
    parts = []
    for field in standardize.FUZZY:
        values = table(spark, d, "silver1_crashes").select(F.upper(F.trim(field)).alias("value")).where("value is not null").distinct()
        values = values.where(standardize.exact(field, F.col("value"), known).isNull())
        parts.append(values.select(F.lit(field).alias("field_name"), "value", standardize.fuzzy_column(field, F.col("value"), of.get(field, [])).alias("m")))
    return reduce(DataFrame.unionByName, parts).select("field_name", "value", "m.canonical", "m.distance")


def _standardized(spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "ref_canonical_mappings")
    return standardize.standardize(_ordered(spark, d), standardize.mapping_dict(ref), standardize.anchors(ref), day_first=F.col("day_first"))


def standardize_route_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _standardized(spark, d).select("table_name", (F.size("columns_to_remediate") == 0).alias("valid"), F.size("fuzzy_audit").alias("fixes"))
    return rows.groupBy("table_name").agg(F.count("*").alias("records"), F.sum(F.col("valid").cast("int")).alias("valid"), F.sum("fixes").alias("fuzzy_fixes"))


def columns_to_remediate(spark: SparkSession, d: str) -> DataFrame:
    long = _standardized(spark, d).select(F.explode("columns_to_remediate").alias("column_name", "value"))
    return long.groupBy("column_name", F.upper(F.trim("value")).alias("value")).agg(F.count("*").alias("records"))


def quarantine_failures(spark: SparkSession, d: str) -> DataFrame:
    rows = failures.from_quarantine(standardize.route(_standardized(spark, d))[1])
    return rows.withColumn("samples", F.array_join("samples", ","))


def quarantine_samples(spark: SparkSession, d: str) -> DataFrame:
    """As quarantine_failures, with up to five record ids of each failure, however few its batches."""
    rows = failures.from_quarantine(standardize.route(_standardized(spark, d))[1], every_id=True)
    return rows.withColumn("samples", F.array_join("samples", ","))


def union_any_sources(spark: SparkSession, d: str) -> DataFrame:
    """The rows of every source there is, united with their source as a tag."""
    rows = table(spark, d, "silver2_crashes")
    names = sorted(r.s for r in rows.select(F.col("table_name").alias("s")).where("s is not null").distinct().limit(1_000).collect())  # sources are tables of their own
    union = gold.union_sources({s: rows.where(F.col("table_name") == s) for s in names})
    return union.groupBy("source_table").agg(F.count("*").alias("records"), F.count("dooring_i").alias("dooring"))


# -- business rows and aggregates


def _gold(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "silver2_crashes").withColumnRenamed("table_name", "source_table")
    return gold.derived(gold.typed(rows))


def gold_projection(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).select(
        "record_id", "source_table", "crash_date", "crash_hour", "latitude", "num_units", "injuries_total", "crash_year", "is_weekend", "time_of_day",
        "is_injury_crash", "is_fatal_crash", "is_injected",
    )


def dedup_business_key(spark: SparkSession, d: str) -> DataFrame:
    return gold.real_crashes(_gold(spark, d)).select("crash_record_id", "record_id", "source_table")


def metric_daily(spark: SparkSession, d: str) -> DataFrame:
    return gold.daily(gold.real_crashes(_gold(spark, d)))


def metric_conditions(spark: SparkSession, d: str) -> DataFrame:
    return gold.conditions(gold.real_crashes(_gold(spark, d)))


def metric_time_pattern(spark: SparkSession, d: str) -> DataFrame:
    return gold.time_pattern(gold.real_crashes(_gold(spark, d)))


def metric_causes(spark: SparkSession, d: str) -> DataFrame:
    return gold.causes(gold.real_crashes(_gold(spark, d)))


def metric_areas(spark: SparkSession, d: str) -> DataFrame:
    return gold.areas(gold.real_crashes(_gold(spark, d)))


# -- failures, lineage, incidents


def failures_once(spark: SparkSession, d: str) -> DataFrame:
    rows = failures.with_signature(failures.delivered_once(table(spark, d, "structured_failures")))
    return rows.select("failure_id", failures.canonical_type(F.col("failure_type")).alias("kind"), failures.family(F.col("failure_type")).alias("family"), "signature_key")


def failures_merged(spark: SparkSession, d: str) -> DataFrame:
    rows = failures.merged(table(spark, d, "structured_failures"))
    return rows.select("folder", "signature_key", "reports", "rows_affected", F.array_join("batches", ",").alias("batches"), F.array_join("samples", ",").alias("samples"), "trusted", "mandatory")


def column_set_jaccard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "structured_failures").where("failure_type = 'SCHEMA_MISMATCH'").select("expected_only", "source_only").distinct()
    join = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    both = rows.select(join("expected_only").alias("expected_only"), join("source_only").alias("source_only"), F.round(incidents.jaccard(F.col("expected_only"), F.col("source_only")), 4).alias("jaccard"))
    return both.distinct()


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """The layers of each source as a graph."""
    source = F.lower("folder")
    names = table(spark, d, "structured_failures").select(source.alias("s")).distinct()
    hop = lambda a, b: F.struct(F.concat(F.lit(a), "s").alias("from_table"), b.alias("to_table"))
    chain = F.array(hop("bronze_", F.concat(F.lit("silver1_"), "s")), hop("silver1_", F.concat(F.lit("silver2_"), "s")), hop("silver1_", F.lit("silver2_quarantine")), hop("silver2_", F.lit("gold")))
    side = spark.createDataFrame([("gold", "gold_daily_summary"), ("gold", "gold_beat_monthly"), ("silver2_quarantine", "silver1_crash1")], "from_table string, to_table string")
    return names.select(F.inline(chain)).unionByName(side)


def lineage_closure(spark: SparkSession, d: str) -> DataFrame:
    return lineage.closure(_edges(spark, d))


def failure_impact(spark: SparkSession, d: str) -> DataFrame:
    rows = failures.delivered_once(table(spark, d, "structured_failures")).withColumn("origin_table", F.concat("origin_layer", F.lit("_"), F.lower("folder")))
    return lineage.impact(rows, _edges(spark, d)).select("failure_id", "origin_table", "reach", "blocked", "score", "tier")


def failure_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The 20 failures with the greatest impact: a top-k report."""
    ranked = failure_impact(spark, d).orderBy(F.col("score").desc(), "failure_id").limit(20)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "failure_id"))).select("rank", "failure_id", "score", "tier")


def incident_matches(spark: SparkSession, d: str) -> DataFrame:
    """For each distinct failure, of any source and type, the most similar of all others."""
    rows = table(spark, d, "structured_failures")
    sets = {c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))) for c in ("expected_only", "source_only")}
    text = F.when(failures.family(F.col("failure_type")) == "SCHEMA", failures.signature_value()).otherwise(F.upper(F.trim(failures.signature_value())))
    keys = rows.withColumns(sets).select("failure_type", "column_name", F.concat("detected_layer", F.lit("_"), F.lower("folder")).alias("table_name"), F.col("detected_layer").alias("layer"), text.alias("raw_value"), *sets)
    identity = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("failure_type", "table_name", "column_name", "raw_value")))
    keys = keys.withColumn("signature_id", F.sha2(identity, 256)).dropDuplicates(["signature_id"])
    return incidents.similar(keys, keys)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return incidents.nearest(rows, rows.where("vec_id % 100 = 0"), vec_id="vec_id", vector="embedding", k=5)


# -- looking at tables


def record_trace(spark: SparkSession, d: str) -> DataFrame:
    layers = {"cleaned": table(spark, d, "silver1_crashes"), "standardized": table(spark, d, "silver2_crashes"), "parked": table(spark, d, "silver1_dead_letter")}
    return inspect.trace(layers)


def layer_differences(spark: SparkSession, d: str) -> DataFrame:
    """Columns that differ between the first and the last arrival of a standardized record."""
    rows = table(spark, d, "silver2_crashes")
    pick = lambda f: rows.groupBy("record_id").agg(f(F.struct("ingestion_ts", "crash_hour", "weather_condition", "damage")).alias("r")).select("record_id", "r.*")
    return inspect.differences(pick(F.min), pick(F.max), "record_id", ["ingestion_ts", "crash_hour", "weather_condition", "damage"])


def layer_changes(spark: SparkSession, d: str) -> DataFrame:
    """All crash columns of each record over the layers, from unified messages to business rows, where they differ."""
    bronze, order = table(spark, d, "bronze_crashes"), ("ingestion_ts", "batch_id")
    first = lambda df: inspect.first_arrivals(df.select("record_id", *order, *CRASH_COLUMNS), "record_id", order)
    rows = stage(first(table(spark, d, "silver2_crashes")), "layer-standardized")  # the business rows are made from the same arrivals
    business = gold.typed(rows.withColumn("source_table", F.lit(None).cast("string")))
    layers = {"bronze": first(drift.unified(bronze, *drift.read_headers(bronze))), "silver1": first(table(spark, d, "silver1_crashes")), "silver2": rows, "gold": business}
    return inspect.layer_changes(layers, "record_id", CRASH_COLUMNS)


def mentioned_ids(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "bronze_crashes").where("try_parse_json(raw_value) is null")
    return inspect.mentions(texts, "raw_value", table(spark, d, "silver1_crashes"), "record_id")


def layer_overview(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        table(spark, d, name).groupBy(F.col(source).alias("source")).agg(F.lit(name).alias("layer"), F.count("*").alias("records"), F.count_distinct("record_id").alias("ids"))
        for name, source in (("silver1_crashes", "table_name"), ("silver2_crashes", "table_name"), ("silver1_dead_letter", "source_table"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def waiting_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda name, c: table(spark, d, name).groupBy(F.col(c).alias("source")).agg(F.count("*").alias(name))
    all_ = n("silver1_crashes", "table_name").join(n("silver2_crashes", "table_name"), "source", "left").join(n("silver1_dead_letter", "source_table"), "source", "left")
    left = F.col("silver1_crashes") - F.coalesce("silver2_crashes", F.lit(0)) - F.coalesce("silver1_dead_letter", F.lit(0))
    return all_.select("source", F.greatest(left, F.lit(0)).alias("waiting"))


def never_standardized(spark: SparkSession, d: str) -> DataFrame:
    """Records of the clean table that the standardized one hasn't: anti-join on ids."""
    rows = table(spark, d, "silver1_crashes").select("record_id", "table_name").distinct()
    missing = rows.join(table(spark, d, "silver2_crashes").select("record_id"), "record_id", "left_anti")
    return missing.groupBy("table_name").agg(F.count("*").alias("records"))


def parked_and_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean records whose id is parked as well: semi-join on distinct ids."""
    rows = table(spark, d, "silver1_crashes").join(table(spark, d, "silver1_dead_letter").select("record_id").distinct(), "record_id", "left_semi")
    return rows.groupBy("table_name").agg(F.count_distinct("record_id").alias("records"))


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 50 records in an order made by a seed: a sampling operator."""
    return inspect.sample(table(spark, d, "silver1_crashes"), "record_id", 50, "7").select("record_id")


def id_lookup(spark: SparkSession, d: str) -> DataFrame:
    return inspect.by_id(table(spark, d, "silver1_crashes"), "00").select("record_id", "crash_record_id", "table_name").distinct()


def next_record(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "silver1_crashes").select("record_id").distinct()
    return inspect.neighbour(ids, "record_id", "8").unionByName(inspect.neighbour(ids, "record_id", "8", after=False))


def event_spread(spark: SparkSession, d: str) -> DataFrame:
    return inspect.spread(table(spark, d, "events"), ["event_type"], "value")


def failure_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = failures.delivered_once(table(spark, d, "structured_failures")).groupBy("folder")
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = rows.agg(F.count("*").alias("failures"), flag(F.col("trusted")).alias("trusted"), flag(F.col("failure_type") == "SCHEMA_MISMATCH").alias("schema"), flag(F.col("mandatory")).alias("mandatory"))
    return out.select("folder", "failures", inspect.rate(F.col("trusted"), F.col("failures")).alias("trusted_rate"), inspect.rate(F.col("schema"), F.col("failures")).alias("schema_rate"), inspect.rate(F.col("mandatory"), F.col("schema")).alias("mandatory_rate"))


def outcome_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "structured_failures")
    return rows.groupBy("folder").pivot("failure_type", ["SCHEMA_MISMATCH", "UNRESOLVED_VALUE"]).agg(F.count(F.lit(1))).na.fill(0).select("folder", F.col("SCHEMA_MISMATCH").alias("schema_mismatch"), F.col("UNRESOLVED_VALUE").alias("unresolved_value"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"))


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    return rows.select(
        "c_custkey", F.upper(F.trim("c_name")).alias("upper_name"), F.length("c_name").alias("letters"), F.instr("c_name", "1").alias("at"), F.concat_ws("|", "c_mktsegment", "c_name").alias("joined"),
        F.substring(F.sha2(F.col("c_name"), 256), 1, 16).alias("hash"), F.regexp_extract("c_name", r"(\d+)", 1).try_cast("int").alias("number"), F.round(F.greatest(F.col("c_acctbal"), F.lit(0.0)), 2).alias("balance"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.col("c_name").startswith("Customer#0000").alias("begins"),
    )


def replay_renamed(spark: SparkSession, d: str) -> DataFrame:
    """How each batch fares when three drifted keys are renamed back."""
    bronze = table(spark, d, "bronze_crashes").withColumn("batch_id", F.get_json_object("raw_value", "$.batch_id"))
    return replay.renamed_batches(bronze, ["topic", "batch_id"], RENAME)


def replay_conservation(spark: SparkSession, d: str) -> DataFrame:
    """Nothing is lost or doubled when clean records are routed into valid and quarantined ones."""
    rows = _standardized(spark, d)
    valid, held = standardize.route(rows.dropDuplicates(["record_id"]))
    return replay.conserved(table(spark, d, "silver1_crashes").dropDuplicates(["record_id"]), valid, held)


def fault_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What standardizing makes of faults put into the months of standardized records."""
    ref = table(spark, d, "ref_canonical_mappings")
    rows = table(spark, d, "silver2_crashes").select(*(F.col(c).cast("string").alias(c) for c in ("record_id", "table_name", *CRASH_COLUMNS)))
    injected = faults.inject(rows, "crash_month")
    done = standardize.standardize(injected, standardize.mapping_dict(ref), standardize.anchors(ref), day_first=F.lit(False))
    return faults.outcomes(done, "crash_month")


def canonical_values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ref_canonical_mappings").groupBy("field_name").agg(F.array_sort(F.collect_set("canonical_value")).alias("v"))
    return rows.select("field_name", F.size("v").alias("n"), F.array_join("v", "|").alias("canonical_values"))


def batch_runs(spark: SparkSession, d: str) -> DataFrame:
    """Records of each batch with their first and last arrival and the blanks among their dates."""
    rows = table(spark, d, "silver1_crashes").groupBy("table_name", "batch_id")
    blank = F.sum(F.when(F.col("crash_date").isNull(), 1).otherwise(0)).alias("without_date")
    return rows.agg(F.count("*").alias("records"), F.min("kafka_timestamp").alias("first_at"), F.max("kafka_timestamp").alias("last_at"), blank)


def promotion_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt months that the guarded match resolves in at least 5 records of at least 3 batches."""
    ref = table(spark, d, "ref_canonical_mappings")
    fixes = _fuzzy(spark, d).where("field_name = 'crash_month' and canonical is not null")
    seen = table(spark, d, "silver1_crashes").select(F.upper(F.trim("crash_month")).alias("value"), F.concat_ws(":", "table_name", "batch_id").alias("batch"))
    counted = seen.groupBy("value").agg(F.count("*").alias("records"), F.count_distinct("batch").alias("batches")).where("records >= 5 and batches >= 3")
    known = ref.where("field_name = 'crash_month'").select(F.upper(F.trim("raw_synonym")).alias("value"))
    return counted.join(fixes, "value").join(known, "value", "left_anti").select("value", "canonical", "records", "batches")


def promotion_by_field(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt values of every fuzzy field that the guarded match resolves in at least 5 records of at least 3 batches."""
    fixes = _fuzzy(spark, d).where("canonical is not null")
    pairs = F.array(*(F.struct(F.lit(c).alias("field_name"), F.upper(F.trim(c)).alias("value")) for c in standardize.FUZZY))
    seen = table(spark, d, "silver1_crashes").select(F.concat_ws(":", "table_name", "batch_id").alias("batch"), F.inline(pairs)).where("value is not null")
    counted = seen.groupBy("field_name", "value").agg(F.count("*").alias("records"), F.count_distinct("batch").alias("batches")).where("records >= 5 and batches >= 3")
    known = table(spark, d, "ref_canonical_mappings").select("field_name", F.upper(F.trim("raw_synonym")).alias("value"))
    return counted.join(fixes, ["field_name", "value"]).join(known, ["field_name", "value"], "left_anti").select("field_name", "value", "canonical", "records", "batches")


def id_set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Ids by the tables they occur in: intersection and differences as set operations."""
    a, b = table(spark, d, "silver1_crashes").select("record_id"), table(spark, d, "silver2_crashes").select("record_id")
    sets = {"both": a.intersect(b), "first_only": a.exceptAll(b).distinct().subtract(b), "second_only": b.subtract(a)}
    parts = [s.agg(F.lit(name).alias("which"), F.count("*").alias("ids")) for name, s in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stream_to_layers(spark: SparkSession, d: str) -> DataFrame:
    """The raw messages streamed through the guard into clean and parked tables, then counted."""
    from lakewright.session import fresh_path
    from lakewright.sources.versioned import VersionedTable
    from lakewright.streaming import layers

    root = fresh_path(spark, "stream")
    good, parked = VersionedTable(spark, f"{root}/clean"), VersionedTable(spark, f"{root}/parked")
    query = layers.start(layers.messages(spark, f"{d}/bronze_crashes.parque[t]"), layers.to_clean(good, parked, "bronze"), f"{root}/checkpoint", f"stream-{root[-8:]}")
    query.awaitTermination()
    parts = [t.read().groupBy("topic").agg(F.lit(name).alias("layer"), F.count("*").alias("records")) for name, t in (("clean", good), ("parked", parked))]
    return parts[0].unionByName(parts[1])


def stream_all_layers(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned rows streamed over two tables of sources into standardized, held and business rows and a refreshed aggregate, then counted."""
    from lakewright.session import fresh_path
    from lakewright.sources.versioned import VersionedTable
    from lakewright.streaming import layers

    root = fresh_path(spark, "layers")
    t = lambda name: VersionedTable(spark, f"{root}/{name}")
    rows, ref = table(spark, d, "silver1_crashes"), standardize.with_spellings(table(spark, d, "ref_canonical_mappings"), "damage", standardize.DAMAGE)
    days = table(spark, d, "source_profiles").select("table_name", (F.col("date_order") == "DMY").alias("day_first"))
    ordered = lambda batch: batch.join(days, "table_name", "left").withColumn("day_first", F.coalesce("day_first", F.lit(False)))
    group = F.coalesce(F.pmod(F.xxhash64("table_name"), F.lit(2)), F.lit(0))
    starts = []
    for k in (0, 1):
        t(f"clean{k}").append(rows.where((group == k) & (F.hour("kafka_timestamp") < 12)))
        t(f"clean{k}").compact()  # no append: the stream passes it over
        t(f"clean{k}").append(rows.where((group == k) & ~F.coalesce(F.hour("kafka_timestamp") < 12, F.lit(False))))
        handle = layers.to_standardized(t(f"valid{k}"), t("held"), t("audit"), t("dead"), lambda: ref, ordered, f"clean{k}")
        starts.append(lambda k=k, handle=handle: layers.follow(spark, [t(f"clean{k}")], handle, f"{root}/check-clean{k}", f"clean{k}-{root[-8:]}"))
    starts.append(lambda: layers.follow(spark, [t("valid0"), t("valid1")], layers.to_business(t("business")), f"{root}/check-business", f"business-{root[-8:]}"))
    starts.append(lambda: layers.follow(spark, [t("business")], layers.refresh(t("business"), {"daily": t("daily")}, {"daily": gold.daily}), f"{root}/check-daily", f"daily-{root[-8:]}"))
    layers.run_layers(starts)
    count = lambda df, layer, source: df.groupBy(F.col(source).alias("source")).agg(F.lit(layer).alias("layer"), F.count("*").alias("records"))
    valid = t("valid0").read().unionByName(t("valid1").read())
    daily = t("daily").read().agg(F.lit(None).cast("string").alias("source"), F.lit("daily").alias("layer"), F.coalesce(F.sum("crashes"), F.lit(0)).alias("records"))
    parts = [count(valid, "valid", "table_name"), count(t("held").read(), "held", "table_name"), count(t("audit").read(), "audit", "table_name"), count(t("business").read(), "business", "source_table"), daily]
    return reduce(DataFrame.unionByName, parts)


def replay_released(spark: SparkSession, d: str) -> DataFrame:
    """Records held while only seed spellings and one damage class were known, and what becomes of them when they are replayed, twice, with all spellings."""
    from lakewright.session import fresh_path
    from lakewright.sources.versioned import VersionedTable

    root = fresh_path(spark, "replay")
    valid, held, audit = (VersionedTable(spark, f"{root}/{x}") for x in ("valid", "held", "audit"))
    known = table(spark, d, "ref_canonical_mappings")
    ref, seeds = standardize.with_spellings(known, "damage", standardize.DAMAGE), standardize.with_spellings(known.where("added_by = 'seed'"), "damage", standardize.DAMAGE[:1])
    done = stage(standardize.standardize(_ordered(spark, d), standardize.mapping_dict(seeds), standardize.anchors(seeds), day_first=F.col("day_first")), "replay-first")
    good, bad = standardize.route(done)
    valid.append(good)
    held.append(bad.drop("fuzzy_audit").withColumn("healing_status", F.lit("PENDING")))
    for _ in range(2):  # the second finds nothing to do
        replay.replay_quarantine(held, valid, ref, day_first=F.col("day_first"), audit=audit, apply=True)
    n = F.count_distinct("record_id").alias("records")
    states = held.read().groupBy("table_name", F.col("healing_status").alias("state")).agg(n)
    return states.unionByName(valid.read().groupBy("table_name").agg(F.lit("VALID").alias("state"), n))


def replay_checks(spark: SparkSession, d: str) -> DataFrame:
    """What speaks for and against one new spelling, JULE for JUNE: the records that hold it, standardized before and after."""
    ref, rows = table(spark, d, "ref_canonical_mappings"), _ordered(spark, d).where("upper(trim(crash_month)) = 'JULE'")
    known, of = standardize.mapping_dict(ref), standardize.anchors(ref)
    run = lambda mappings: standardize.standardize(rows, mappings, of, day_first=F.col("day_first"))
    before = stage(run(known), "checks-before").groupBy("record_id").agg(F.min(F.array_sort(F.map_keys("columns_to_remediate"))).alias("before"))
    after = run(standardize.overlay(known, {"crash_month": {"JULE": "JUNE"}})).join(before, "record_id", "left")
    shown = stage(after.select("record_id", F.lit("PENDING").alias("healing_status"), F.lit(None).cast("string").alias("resolved_by"), "before", F.col("columns_to_remediate").alias("after"), F.col("crash_month").alias("value"), "crash_date"), "checks-after")
    values = sorted(set(known["crash_month"].values()))
    return replay.checks(
        rows.select("record_id"), shown, table(spark, d, "silver2_crashes"), execution_id="e", column="crash_month", raw_value="JULE", canonical="JUNE",
        canonical_values=values, existing=known["crash_month"].get("JULE"),
    )


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Run events of the batches, as JSON lines: each batch of a source starts and completes a run of every layer, the side tables one run each."""
    batches = table(spark, d, "silver1_crashes").select(F.lower("table_name").alias("s"), "batch_id").where("s is not null").distinct()
    field = lambda names: F.array(*(F.struct(F.lit(c).alias("name"), F.lit("string").alias("type")) for c in names))
    data = lambda name, names=None: F.struct(F.lit("file").alias("namespace"), F.concat(F.lit("/data/"), name).alias("name"), F.struct(F.struct(field(names).alias("fields")).alias("schema")).alias("facets"))
    name = lambda layer: F.concat(F.lit(f"{layer}_"), "s")
    run = lambda a, outs: F.struct(F.array(F.struct(F.lit("file").alias("namespace"), F.concat(F.lit("/data/"), a).alias("name"))).alias("inputs"), F.array(*outs).alias("outputs"))
    kept = [c for c in CRASH_COLUMNS if c in GOLD_COLUMNS]
    hops = F.array(
        run(name("bronze"), [data(name("silver1"), CRASH_COLUMNS)]), run(name("silver1"), [data(name("silver2"), CRASH_COLUMNS), data(F.lit("silver2_quarantine"), ["record_id"])]), run(name("silver2"), [data(F.lit("gold"), kept)]),
        run(F.lit("gold"), [data(F.lit("gold_daily_summary"), ["crash_date"])]),
    )
    runs = batches.select("s", "batch_id", F.posexplode(hops).alias("hop", "r")).select("*", F.explode(F.array(F.lit("START"), F.lit("COMPLETE"), F.lit("NOISE"))).alias("eventType"))
    run_id = F.concat_ws("-", "s", F.col("batch_id").cast("string"), F.col("hop").cast("string"))
    event = F.struct("eventType", F.concat(F.lit("2024-01-01T00:00:0"), F.col("hop").cast("string")).alias("eventTime"), F.struct(F.lit("n").alias("namespace"), run_id.alias("name")).alias("job"), F.struct(run_id.alias("runId")).alias("run"), "r.inputs", "r.outputs")
    return runs.select(F.to_json(event).alias("value"))


GOLD_COLUMNS = (
    "crash_record_id", "crash_date", "crash_hour", "crash_day_of_week", "crash_month", "weather_condition", "lighting_condition", "roadway_surface_cond", "prim_contributory_cause", "posted_speed_limit", "beat_of_occurrence", "latitude", "longitude",
    "num_units", "injuries_total", "injuries_fatal", "hit_and_run_i", "damage", "street_name", "street_direction",
)


def lineage_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs by job and last status, from the events; unknown statuses are left out."""
    return lineage.runs(lineage.read_events(_events(spark, d))).groupBy("job", "status").agg(F.count("*").alias("runs"))


def lineage_from_events(spark: SparkSession, d: str) -> DataFrame:
    """Everything upstream of each table, by the events."""
    return lineage.upstream(lineage.closure(lineage.feeds(lineage.read_events(_events(spark, d)))))


def failure_impact_events(spark: SparkSession, d: str) -> DataFrame:
    """Impact of the reported failures by the lineage of the events, with propagation by column."""
    events = stage(lineage.read_events(_events(spark, d)), "lineage-events")
    rows = failures.delivered_once(table(spark, d, "structured_failures"))
    scored = lineage.impact_by_lineage(rows, lineage.feeds(events), lineage.schema_versions(events))
    return scored.select("failure_id", "origin_table", "lineage_known", "reach", "blocked", "propagation", "score", "tier")


def clean_all(spark: SparkSession, d: str) -> DataFrame:
    """All 49 crash columns of every readable message, cleaned; a value that is an object is JSON text with its keys in order."""
    return clean.clean(clean.unpack(table(spark, d, "bronze_crashes"), POSITION)).select(*POSITION, *CRASH_COLUMNS)


def failure_counts(spark: SparkSession, d: str) -> DataFrame:
    """Failures by folder and type, whatever types there are."""
    return table(spark, d, "structured_failures").groupBy("folder", "failure_type").agg(F.count("*").alias("failures"), F.sum("rows_affected").alias("rows_affected"))


def failure_rank(spark: SparkSession, d: str) -> DataFrame:
    """The 20 failures with the greatest impact, ties by the rows affected and then by id: a top-k report."""
    rows = failures.delivered_once(table(spark, d, "structured_failures")).select("failure_id", F.coalesce("rows_affected", F.lit(-1)).alias("affected"))
    order = [F.col("score").desc(), F.col("affected").desc(), F.col("failure_id")]
    ranked = failure_impact(spark, d).join(rows, "failure_id").orderBy(*order).limit(20)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "failure_id", "score", "affected", "tier")


def map_lookup_all(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of every mapped column with the canonical value they stand for, NULL where there is none."""
    fields = [c for c in CRASH_COLUMNS if c in MAPPED]
    pairs = F.array(*(F.struct(F.lit(c).alias("field_name"), F.upper(F.trim(c)).alias("spelling")) for c in fields))
    seen = table(spark, d, "silver1_crashes").select(F.inline(pairs)).groupBy("field_name", "spelling").agg(F.count("*").alias("records"))
    return seen.join(mapping_latest(spark, d), ["field_name", "spelling"], "left").select("field_name", "spelling", "records", "canonical_value")


MAPPED = (*standardize.FUZZY, "damage", "hit_and_run_i")


# -- SQL

_TOP = "json_valid(raw_value) AND json_type(raw_value) = 'OBJECT'"


def _title(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


_CLEAN = {c: (lambda t: f"lower({t})" if c in clean.LOWER else _title(t) if c in clean.TITLE else f"upper({t})" if c in clean.UPPER else t)("trim(x)") for c in SHOWN}
_WANTED = "[" + ", ".join(f"'{c}'" for c in CRASH_COLUMNS) + "]"
_GUARD = f"""
WITH a AS (SELECT *, CASE WHEN json_valid(raw_value) AND json_type(raw_value) = 'OBJECT' THEN raw_value END AS j FROM bronze_crashes),
b AS (SELECT topic, kafka_partition, kafka_offset, CASE WHEN j IS NULL THEN NULL WHEN json_type(j, '$.payload') IS NULL THEN list_filter(json_keys(j), lambda k: NOT list_contains(['record_id', 'batch_id', 'table_name', 'ingestion_ts', 'payload'], k))
      WHEN json_type(j, '$.payload') = 'OBJECT' THEN json_keys(j, '$.payload') END AS keys FROM a),
c AS (SELECT *, list_sort(list_filter({_WANTED}, lambda w: NOT list_contains(COALESCE(keys, []), w))) AS eo, list_sort(list_filter(COALESCE(keys, []), lambda k: NOT list_contains({_WANTED}, k))) AS so FROM b),
g AS (SELECT topic, kafka_partition, kafka_offset, CASE WHEN keys IS NULL THEN 'CORRUPT_RECORD' ELSE 'SCHEMA_MISMATCH' END AS error_class, array_to_string(eo, ',') AS expected_only, array_to_string(so, ',') AS source_only
      FROM c WHERE keys IS NULL OR len(eo) > 0 OR len(so) > 0)
"""
_LATEST = """
m AS (SELECT field_name, upper(trim(raw_synonym)) AS spelling, canonical_value, row_number() OVER (PARTITION BY field_name, upper(trim(raw_synonym)) ORDER BY added_at DESC NULLS LAST, canonical_value DESC) AS n
      FROM ref_canonical_mappings WHERE raw_synonym IS NOT NULL AND canonical_value IS NOT NULL),
latest AS (SELECT field_name, spelling, canonical_value FROM m WHERE n = 1)
"""


def _strptime(formats: list[str], text: str = "crash_date") -> str:
    return "COALESCE(" + ", ".join(f"try_strptime({text}, '{f}')" for f in formats) + ")"


_ISO = ["%Y-%m-%dT%H:%M:%S.%g", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d"]
_MDY = ["%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y", "%m-%d-%Y"]
_DMY = [f.replace("%m", "%_").replace("%d", "%m").replace("%_", "%d") for f in _MDY]
_FUZZY = "WITH " + _LATEST + """,
seeds AS (SELECT DISTINCT field_name, upper(trim(raw_synonym)) AS s, upper(trim(canonical_value)) AS c FROM ref_canonical_mappings WHERE added_by = 'seed'),
spell AS (SELECT DISTINCT field_name, c AS s, c FROM seeds UNION SELECT field_name, s, c FROM seeds WHERE length(regexp_replace(s, '[^A-Z]', '', 'g')) >= 3),
anchor AS (SELECT field_name, s, CASE WHEN bool_or(s = c) THEN s ELSE min(c) END AS c FROM spell GROUP BY field_name, s HAVING count(DISTINCT c) = 1 OR bool_or(s = c)),
vals AS (""" + " UNION ".join(f"SELECT '{c}' AS field_name, upper(trim({c})) AS value FROM silver1_crashes WHERE {c} IS NOT NULL" for c in standardize.FUZZY) + """),
open AS (SELECT v.* FROM vals v ANTI JOIN latest l ON l.field_name = v.field_name AND l.spelling = v.value),
d AS (SELECT o.field_name, o.value, a.s, a.c, damerau_levenshtein(o.value, a.s) AS d FROM open o JOIN anchor a USING (field_name)),
per AS (SELECT field_name, value, c, min(d) AS any_d, min(CASE WHEN s = c OR (length(regexp_replace(s, '[^A-Z]', '', 'g')) >= 6 AND d <= 1) THEN d END) AS win FROM d GROUP BY ALL),
best AS (SELECT field_name, value, min(struct_pack(d := win, c := c)) FILTER (WHERE win IS NOT NULL) AS b FROM per GROUP BY ALL),
f AS (SELECT b.field_name, b.value, b.b.c AS c, b.b.d AS d, COALESCE((SELECT min(p.any_d) FROM per p WHERE p.field_name = b.field_name AND p.value = b.value AND p.c <> b.b.c), 1000) AS other FROM best b),
r AS (SELECT field_name, value, CASE WHEN ok THEN c END AS canonical, CASE WHEN ok THEN d END AS distance FROM (SELECT *, length(value) >= 4 AND d <= greatest(1, CAST(floor(length(value) * 0.25) AS INT)) AND other - d >= 2 AS ok FROM f))
"""
_CLOCK = ["%I %p", "%H:%M", "%I:%M %p", "%H.%M", "%I.%M %p"]


def _mapped(c: str) -> str:
    return f"(SELECT min(canonical_value) FROM latest l WHERE l.field_name = '{c}' AND l.spelling = upper(trim(b.{c})))"


def _hour(mapped: str) -> str:
    """Hour of crash_hour as a number, before its range is checked."""
    number = r"CASE WHEN regexp_full_match(trim(crash_hour), '\d{1,2}(\.\d+)?') THEN CAST(trunc(TRY_CAST(trim(crash_hour) AS DOUBLE)) AS INT) WHEN regexp_full_match(trim(crash_hour), '\d{3}') THEN TRY_CAST(trim(crash_hour) AS INT) END"
    return f"COALESCE(TRY_CAST({mapped} AS INT), CAST(hour({_strptime(_CLOCK, 'crash_hour')}) AS INT), {number})"


def _standard_sql() -> str:
    """x: one row per column that resists in a record; every record of the clean table has a number in b."""
    date_ = f"CASE WHEN df THEN {_strptime([*_ISO, *_DMY, '%Y%m%d'])} ELSE {_strptime([*_ISO, *_MDY, *_DMY, '%Y%m%d'])} END"
    iso = [f for f in _ISO if f != "%Y/%m/%d"]
    police = f"CASE WHEN df THEN {_strptime([*iso, *_DMY], 'date_police_notified')} ELSE {_strptime([*iso, *_MDY], 'date_police_notified')} END"
    bad = {c: f"NOT EXISTS (SELECT 1 FROM latest l WHERE l.field_name = '{c}' AND l.spelling = upper(trim(b.{c}))) AND NOT EXISTS (SELECT 1 FROM r WHERE r.field_name = '{c}' AND r.value = upper(trim(b.{c})) AND canonical IS NOT NULL)" for c in standardize.FUZZY}
    bad |= {
        "damage": f"{_mapped('damage')} IS NULL", "hit_and_run_i": f"TRY_CAST({_mapped('hit_and_run_i')} AS BOOLEAN) IS NULL", "date_police_notified": f"({police}) IS NULL",
        "crash_hour": f"COALESCE({_hour(_mapped('crash_hour'))}, 99) NOT BETWEEN 0 AND 23", "num_units": f"{_mapped('num_units')} IS NULL AND regexp_extract(num_units, '\\d') = ''",
        "posted_speed_limit": "regexp_extract(posted_speed_limit, '\\d') = ''",
    }
    parts = [f"SELECT n, table_name, batch_id, record_id, '{c}' AS column_name, {c} AS value FROM b WHERE {c} IS NOT NULL AND trim({c}) <> '' AND {rule}" for c, rule in bad.items()]
    parts.append(f"SELECT n, table_name, batch_id, record_id, 'crash_date' AS column_name, COALESCE(crash_date, '{standardize.MISSING}') AS value FROM b WHERE ({date_}) IS NULL")
    numbered = "b AS (SELECT s.*, COALESCE(date_order = 'DMY', false) AS df, row_number() OVER () AS n FROM silver1_crashes s LEFT JOIN source_profiles USING (table_name))"
    return _FUZZY + f", {numbered}, x AS ({' UNION ALL '.join(parts)})"


_FIXES = " + ".join(f"CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.field_name = '{c}' AND r.value = upper(trim(b.{c})) AND canonical IS NOT NULL) THEN 1 ELSE 0 END" for c in standardize.FUZZY)
_GOLD = """
WITH t AS (SELECT record_id, crash_record_id, table_name AS source_table, TRY_CAST(crash_date AS DATE) AS crash_date, TRY_CAST(trunc(TRY_CAST(crash_hour AS DOUBLE)) AS INT) AS crash_hour, crash_day_of_week, beat_of_occurrence,
  weather_condition, lighting_condition, roadway_surface_cond, prim_contributory_cause, TRY_CAST(posted_speed_limit AS INT) AS posted_speed_limit, hit_and_run_i, TRY_CAST(latitude AS DOUBLE) AS latitude,
  CAST(trunc(num_units) AS INT) AS num_units, TRY_CAST(trunc(TRY_CAST(injuries_total AS DOUBLE)) AS INT) AS injuries_total, TRY_CAST(trunc(TRY_CAST(injuries_fatal AS DOUBLE)) AS INT) AS injuries_fatal FROM silver2_crashes),
g AS (SELECT *, year(crash_date) AS crash_year, crash_day_of_week IN ('SATURDAY', 'SUNDAY') AS is_weekend,
  CASE WHEN crash_hour IS NULL THEN NULL WHEN crash_hour BETWEEN 6 AND 11 THEN 'MORNING' WHEN crash_hour BETWEEN 12 AND 16 THEN 'AFTERNOON' WHEN crash_hour BETWEEN 17 AND 20 THEN 'EVENING' ELSE 'NIGHT' END AS time_of_day,
  injuries_total > 0 AS is_injury_crash, injuries_fatal > 0 AS is_fatal_crash, COALESCE(crash_record_id LIKE 'FAULT-%', false) AS is_injected FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY crash_record_id ORDER BY record_id) AS n FROM g WHERE NOT is_injected),
r AS (SELECT * FROM o WHERE crash_record_id IS NULL OR n = 1)
"""
_N = """count(*) AS crashes, CAST(sum(CASE WHEN is_injury_crash THEN 1 ELSE 0 END) AS BIGINT) AS injury_crashes, CAST(sum(CASE WHEN is_fatal_crash THEN 1 ELSE 0 END) AS BIGINT) AS fatal_crashes,
 CAST(COALESCE(sum(injuries_total), 0) AS BIGINT) AS injuries_total, CAST(COALESCE(sum(injuries_fatal), 0) AS BIGINT) AS injuries_fatal"""


def _part(c: str, name: str) -> str:
    return f"round(avg(CASE WHEN {c} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 4) AS {name}"


_NIGHT = _part("time_of_day = 'NIGHT'", "night_share")
_R = _part("is_injury_crash", "injury_rate") + ", " + _part("is_fatal_crash", "fatal_rate")
_ONCE = """
WITH u AS (SELECT *, row_number() OVER (PARTITION BY failure_id) AS n FROM structured_failures), f AS (SELECT * FROM u WHERE n = 1),
s AS (SELECT *, COALESCE(detected_layer, '') || '|' || COALESCE(column_name, '') || '|' || upper(trim(CASE WHEN failure_type IN ('SCHEMA_MISMATCH', 'SCHEMA_DRIFT', 'MISSING_COLUMN')
  THEN 'EXPECTED_ONLY=' || array_to_string(list_sort(COALESCE(expected_only, [])), ',') || ';SOURCE_ONLY=' || array_to_string(list_sort(COALESCE(source_only, [])), ',') ELSE COALESCE(raw_value, '') END)) AS signature_key FROM f)
"""
_EDGES = """
names AS (SELECT DISTINCT lower(folder) AS s FROM structured_failures),
edges AS (SELECT 'bronze_' || s AS from_table, 'silver1_' || s AS to_table FROM names UNION SELECT 'silver1_' || s, 'silver2_' || s FROM names UNION SELECT 'silver1_' || s, 'silver2_quarantine' FROM names
  UNION SELECT 'silver2_' || s, 'gold' FROM names UNION SELECT * FROM (VALUES ('gold', 'gold_daily_summary'), ('gold', 'gold_beat_monthly'), ('silver2_quarantine', 'silver1_crash1'))),
reach AS (SELECT from_table, to_table, 1 AS depth, [from_table, to_table] AS path FROM edges
  UNION ALL SELECT r.from_table, e.to_table, r.depth + 1, list_append(r.path, e.to_table) FROM reach r JOIN edges e ON r.to_table = e.from_table WHERE NOT list_contains(r.path, e.to_table)),
closed AS (SELECT from_table, to_table, min(depth) AS depth FROM reach GROUP BY ALL)
"""
_WEIGHT = """CASE WHEN {t} IN ('silver2_quarantine', 'silver1_dead_letter') THEN 0.0 WHEN {t} LIKE 'bronze%' THEN 1.0 WHEN {t} LIKE 'silver1%' THEN 2.0 WHEN {t} LIKE 'silver2%' THEN 3.0 WHEN {t} LIKE 'gold%' THEN 5.0 ELSE 0.5 END"""
_IMPACT = f"""
WITH RECURSIVE {_EDGES},
u AS (SELECT *, row_number() OVER (PARTITION BY failure_id) AS n FROM structured_failures), f AS (SELECT *, origin_layer || '_' || lower(folder) AS origin_table FROM u WHERE n = 1),
w AS (SELECT from_table AS origin_table, sum({_WEIGHT.format(t="to_table")}) AS down FROM closed GROUP BY 1),
k AS (SELECT origin_table, count(*) AS there FROM f GROUP BY 1),
b AS (SELECT from_table AS origin_table, sum(there) AS blocked FROM closed JOIN k ON k.origin_table = closed.to_table GROUP BY 1),
x AS (SELECT f.*, COALESCE(w.down, 0) + CASE WHEN origin_affected THEN {_WEIGHT.format(t="f.origin_table")} ELSE 0 END AS reach, CAST(COALESCE(b.blocked, 0) AS BIGINT) AS blocked FROM f LEFT JOIN w USING (origin_table) LEFT JOIN b USING (origin_table)),
y AS (SELECT *, 30 * CASE WHEN origin_affected THEN 1.0 ELSE least(1.0, CASE failure_type WHEN 'SCHEMA_MISMATCH' THEN 1.0 WHEN 'UNRESOLVED_VALUE' THEN 0.4 ELSE 0.6 END + CASE WHEN mandatory THEN 0.3 ELSE 0.0 END) END
  + 25 * CASE WHEN reach > 0 THEN CAST(reach AS DOUBLE) / (CAST(reach AS DOUBLE) + 5) ELSE 0.0 END
  + 20 * CASE WHEN rows_affected IS NULL THEN 0.5 WHEN rows_affected <= 0 THEN 0.0 ELSE least(1.0, log10(1 + rows_affected) / log10(10001)) END
  + 15 * CASE WHEN failure_type = 'SCHEMA_MISMATCH' OR origin_affected OR column_name IS NULL THEN 1.0 ELSE 0.5 END + 10 * (blocked / (blocked + 1.0)) AS total FROM x),
i AS (SELECT failure_id, origin_table, CAST(reach AS DOUBLE) AS reach, blocked, CAST(round(total, 1) AS DOUBLE) AS score, CASE WHEN total >= 70 THEN 'P1' WHEN total >= 40 THEN 'P2' ELSE 'P3' END AS tier FROM y)
"""


def _counted(name: str, source: str) -> str:
    return f"SELECT {source} AS source, '{name}' AS layer, count(*) AS records, count(DISTINCT record_id) AS ids FROM {name} GROUP BY {source}"


_SPREAD = """
SELECT event_type, count(*) AS n, round(median(value), 1) AS median, round(list_sort(list(value))[CAST(round_even(0.9 * (count(*) - 1), 0) AS BIGINT) + 1], 1) AS p90, round(max(value), 1) AS max, round(avg(value), 1) AS mean
FROM events WHERE value IS NOT NULL GROUP BY event_type
"""
_ARRIVED = "SELECT record_id, {f}(struct_pack(a := ingestion_ts, b := crash_hour, c := weather_condition, d := damage)) AS r FROM silver2_crashes GROUP BY record_id"

ORACLE = {
    "parse_hours": f"SELECT DISTINCT crash_hour, CASE WHEN h BETWEEN 0 AND 23 THEN lpad(CAST(h AS VARCHAR), 2, '0') || '.00' END AS standard FROM (SELECT crash_hour, {_hour('NULL')} AS h FROM silver1_crashes)",
    "columns_to_remediate": _standard_sql() + "SELECT column_name, upper(trim(value)) AS value, count(*) AS records FROM x GROUP BY 1, 2",
    "standardize_route_counts": _standard_sql() + f"SELECT table_name, count(*) AS records, count(*) FILTER (n NOT IN (SELECT n FROM x)) AS valid, CAST(sum({_FIXES}) AS BIGINT) AS fuzzy_fixes FROM b GROUP BY table_name",
    "quarantine_failures": _standard_sql() + ", p AS (SELECT table_name AS folder, column_name, upper(trim(value)) AS raw_value, batch_id, count(*) AS k, min(record_id) AS sample FROM x GROUP BY 1, 2, 3, 4) SELECT folder, column_name, raw_value, CAST(sum(k) AS BIGINT) AS rows_affected, count(*) AS batches, array_to_string(list_sort(list(DISTINCT sample))[1:5], ',') AS samples, column_name = 'crash_date' AS mandatory FROM p GROUP BY 1, 2, 3",
    "canonical_values": "SELECT field_name, CAST(count(DISTINCT canonical_value) AS INT) AS n, array_to_string(list_sort(list(DISTINCT canonical_value)), '|') AS canonical_values FROM ref_canonical_mappings GROUP BY 1",
    "batch_runs": "SELECT table_name, batch_id, count(*) AS records, min(kafka_timestamp) AS first_at, max(kafka_timestamp) AS last_at, CAST(sum(CASE WHEN crash_date IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_date FROM silver1_crashes GROUP BY 1, 2",
    "promotion_candidates": _FUZZY + ", p AS (SELECT upper(trim(crash_month)) AS value, count(*) AS records, count(DISTINCT table_name || ':' || batch_id) AS batches FROM silver1_crashes GROUP BY 1) SELECT value, canonical, records, batches FROM p JOIN r USING (value) WHERE r.field_name = 'crash_month' AND canonical IS NOT NULL AND records >= 5 AND batches >= 3",
    "promotion_by_field": _FUZZY + ", p AS (SELECT field_name, value, count(*) AS records, count(DISTINCT batch) AS batches FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field_name, upper(trim({c})) AS value, table_name || ':' || batch_id AS batch FROM silver1_crashes" for c in standardize.FUZZY)
    + ") GROUP BY 1, 2) SELECT field_name, value, canonical, records, batches FROM p JOIN r USING (field_name, value) WHERE canonical IS NOT NULL AND records >= 5 AND batches >= 3",
    "id_set_operations": "WITH a AS (SELECT DISTINCT record_id FROM silver1_crashes), b AS (SELECT DISTINCT record_id FROM silver2_crashes) SELECT 'both' AS which, count(*) AS ids FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'second_only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "stream_to_layers": _GUARD + "SELECT b.topic, CASE WHEN g.topic IS NULL THEN 'clean' ELSE 'parked' END AS layer, count(*) AS records FROM bronze_crashes b LEFT JOIN g USING (topic, kafka_partition, kafka_offset) GROUP BY 1, 2",
    "clean_projection": f"WITH e AS (SELECT topic, kafka_partition, kafka_offset, CASE WHEN json_type(raw_value, '$.payload') IS NULL THEN raw_value ELSE json_extract(raw_value, '$.payload') END AS p FROM bronze_crashes WHERE {_TOP}) SELECT topic, kafka_partition, kafka_offset, "
    + ", ".join("nullif(" + _CLEAN[c].replace("(x)", f"(json_extract_string(p, '$.{c}'))") + f", '') AS {c}" for c in SHOWN) + " FROM e",
    "union_sources_tagged": "SELECT table_name AS source_table, count(*) AS records, count(CASE WHEN table_name <> 'Crash2' THEN dooring_i END) AS dooring FROM silver2_crashes WHERE table_name IN ('Crash1', 'Crash2', 'Crash3', 'Crash4') GROUP BY 1",
    "contract_guard": _GUARD + "SELECT * FROM g",
    "contract_signatures": _GUARD + "SELECT topic, error_class, expected_only, source_only, count(*) AS records FROM g GROUP BY ALL",
    "dead_letter_groups": "SELECT source_table, stage, error_class, healing_status, count(*) AS records, count(DISTINCT silver1_batch_id) AS batches FROM silver1_dead_letter GROUP BY ALL",
    "mapping_latest": f"WITH {_LATEST} SELECT * FROM latest",
    "map_lookup_exact": f"WITH {_LATEST}, v AS (SELECT upper(trim(weather_condition)) AS spelling, count(*) AS records FROM silver1_crashes GROUP BY 1) SELECT v.spelling, records, canonical_value FROM v LEFT JOIN latest l ON l.spelling = v.spelling AND l.field_name = 'weather_condition'",
    "parse_dates": f"SELECT DISTINCT crash_date, COALESCE(date_order = 'DMY', false) AS day_first, strftime(CASE WHEN date_order = 'DMY' THEN {_strptime([*_ISO, *_DMY, '%Y%m%d'])} ELSE {_strptime([*_ISO, *_MDY, *_DMY, '%Y%m%d'])} END, '%Y-%m-%d') AS standard FROM silver1_crashes LEFT JOIN source_profiles USING (table_name) WHERE crash_date IS NOT NULL",
    "parse_numbers": r"SELECT DISTINCT posted_speed_limit, num_units, TRY_CAST(nullif(regexp_extract(posted_speed_limit, '(\d{1,4})', 1), '') AS INT) AS speed, CAST(TRY_CAST(nullif(regexp_extract(num_units, '(\d{1,8}(\.\d+)?)', 1), '') AS DECIMAL(10, 1)) AS DOUBLE) AS units FROM silver1_crashes",
    "edit_distance": "SELECT DISTINCT upper(trim(crash_month)) AS a, CAST(damerau_levenshtein(upper(trim(crash_month)), 'SEPTEMBER') AS INT) AS distance FROM silver1_crashes WHERE crash_month IS NOT NULL",
    "fuzzy_canonical": _FUZZY + "SELECT field_name, value, canonical FROM r WHERE field_name IN ('weather_condition', 'crash_month')",
    "fuzzy_audit": _FUZZY + "SELECT field_name, value, canonical, CAST(distance AS INT) AS distance FROM r WHERE canonical IS NOT NULL AND field_name IN ('weather_condition', 'crash_month')",
    "gold_projection": _GOLD + "SELECT record_id, source_table, crash_date, crash_hour, latitude, num_units, injuries_total, crash_year, is_weekend, time_of_day, is_injury_crash, is_fatal_crash, is_injected FROM g",
    "dedup_business_key": _GOLD + "SELECT crash_record_id, record_id, source_table FROM r",
    "metric_daily": _GOLD + f"SELECT crash_date, crash_year, min(is_weekend) AS is_weekend, {_N}, CAST(sum(CASE WHEN hit_and_run_i THEN 1 ELSE 0 END) AS BIGINT) AS hit_and_run_crashes FROM r WHERE crash_date IS NOT NULL GROUP BY crash_date, crash_year",
    "metric_conditions": _GOLD + f"SELECT COALESCE(weather_condition, 'NOT RECORDED') AS weather_condition, COALESCE(lighting_condition, 'NOT RECORDED') AS lighting_condition, COALESCE(roadway_surface_cond, 'NOT RECORDED') AS roadway_surface_cond, {_N}, {_R} FROM r GROUP BY 1, 2, 3",
    "metric_time_pattern": _GOLD + f"SELECT crash_day_of_week, crash_hour, min(time_of_day) AS time_of_day, {_N}, {_R} FROM r WHERE crash_day_of_week IS NOT NULL AND crash_hour IS NOT NULL GROUP BY 1, 2",
    "metric_causes": _GOLD + f"SELECT COALESCE(prim_contributory_cause, 'not recorded') AS prim_contributory_cause, {_N}, {_R}, round(count(*) / sum(count(*)) OVER (), 4) AS share_of_crashes FROM r GROUP BY 1",
    "metric_areas": _GOLD + f"SELECT beat_of_occurrence, CAST(date_trunc('month', crash_date) AS DATE) AS month_start, {_N}, {_R}, {_NIGHT}, {_part('is_weekend', 'weekend_share')}, "
    + _part("weather_condition IN ('RAIN', 'SNOW', 'FOG')", "adverse_weather_share") + ", " + _part("hit_and_run_i", "hit_and_run_share") + ", round(avg(CAST(posted_speed_limit AS DOUBLE)), 1) AS avg_posted_speed_limit FROM r WHERE beat_of_occurrence IS NOT NULL AND crash_date IS NOT NULL GROUP BY 1, 2",
    "failures_once": _ONCE + "SELECT failure_id, replace(upper(trim(failure_type)), 'SCHEMA_MISMATCH', 'SCHEMA_DRIFT') AS kind, CASE failure_type WHEN 'SCHEMA_MISMATCH' THEN 'SCHEMA' WHEN 'UNRESOLVED_VALUE' THEN 'VALUE' ELSE 'UNKNOWN' END AS family, signature_key FROM s",
    "failures_merged": _ONCE + "SELECT folder, signature_key, count(*) AS reports, CAST(sum(rows_affected) AS BIGINT) AS rows_affected, array_to_string(list_sort(list(DISTINCT batch_id)), ',') AS batches, "
    "COALESCE(array_to_string(list_sort(list_distinct(flatten(list(list_sort(COALESCE(sample_record_ids, []))[1:5]))))[1:5], ','), '') AS samples, bool_and(trusted) AS trusted, bool_or(mandatory) AS mandatory FROM s GROUP BY 1, 2",
    "column_set_jaccard": "WITH x AS (SELECT DISTINCT list_sort(COALESCE(expected_only, [])) AS e, list_sort(COALESCE(source_only, [])) AS s FROM structured_failures WHERE failure_type = 'SCHEMA_MISMATCH') "
    "SELECT DISTINCT array_to_string(e, ',') AS expected_only, array_to_string(s, ',') AS source_only, round(CASE WHEN len(e) + len(s) = 0 THEN 1.0 ELSE len(list_intersect(e, s)) / CAST(len(list_distinct(list_concat(e, s))) AS DOUBLE) END, 4) AS jaccard FROM x",
    "lineage_closure": f"WITH RECURSIVE {_EDGES} SELECT * FROM closed",
    "failure_impact": _IMPACT + "SELECT * FROM i",
    "failure_ranking": _IMPACT + "SELECT row_number() OVER (ORDER BY score DESC, failure_id) AS rank, failure_id, score, tier FROM i ORDER BY rank LIMIT 20",
    "vector_topk": "WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round((1 + list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) / 2, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5",
    "record_trace": "WITH u AS (SELECT record_id, 'a' AS l FROM silver1_crashes UNION ALL SELECT record_id, 'b' FROM silver2_crashes UNION ALL SELECT record_id, 'c' FROM silver1_dead_letter) "
    "SELECT record_id, count(*) FILTER (l = 'a') AS cleaned, count(*) FILTER (l = 'b') AS standardized, count(*) FILTER (l = 'c') AS parked FROM u WHERE record_id IS NOT NULL GROUP BY record_id",
    "layer_differences": f"WITH b AS ({_ARRIVED.format(f='min')}), a AS ({_ARRIVED.format(f='max')}), j AS (SELECT b.record_id, b.r AS x, a.r AS y FROM b JOIN a USING (record_id)) "
    + " UNION ALL ".join(f"SELECT record_id, '{c}' AS column_name, trim(x.{k}) AS before, trim(y.{k}) AS after FROM j WHERE trim(x.{k}) IS DISTINCT FROM trim(y.{k})" for k, c in zip("abcd", ("ingestion_ts", "crash_hour", "weather_condition", "damage"), strict=True)),
    "mentioned_ids": f"WITH t AS (SELECT list_distinct(regexp_extract_all(lower(raw_value), '{inspect.UUID}')) AS ids FROM bronze_crashes WHERE NOT json_valid(raw_value)), x AS (SELECT unnest(ids) AS id FROM t) SELECT id, count(*) AS texts FROM x WHERE id IN (SELECT record_id FROM silver1_crashes) GROUP BY id",
    "layer_overview": " UNION ALL ".join(_counted(n, s) for n, s in (("silver1_crashes", "table_name"), ("silver2_crashes", "table_name"), ("silver1_dead_letter", "source_table"))),
    "waiting_counts": "SELECT a.table_name AS source, greatest(a.n - COALESCE(b.n, 0) - COALESCE(c.n, 0), 0) AS waiting FROM (SELECT table_name, count(*) AS n FROM silver1_crashes GROUP BY 1) a LEFT JOIN (SELECT table_name, count(*) AS n FROM silver2_crashes GROUP BY 1) b USING (table_name) LEFT JOIN (SELECT source_table AS table_name, count(*) AS n FROM silver1_dead_letter GROUP BY 1) c USING (table_name)",
    "never_standardized": "SELECT table_name, count(*) AS records FROM (SELECT DISTINCT record_id, table_name FROM silver1_crashes) x WHERE NOT EXISTS (SELECT 1 FROM silver2_crashes y WHERE y.record_id = x.record_id) GROUP BY 1",
    "parked_and_clean": "SELECT table_name, count(DISTINCT record_id) AS records FROM silver1_crashes WHERE record_id IN (SELECT record_id FROM silver1_dead_letter WHERE record_id IS NOT NULL) GROUP BY 1",
    "hash_sample": "SELECT record_id FROM (SELECT DISTINCT record_id FROM silver1_crashes WHERE record_id IS NOT NULL) ORDER BY md5(record_id || '7'), record_id LIMIT 50",
    "id_lookup": "SELECT DISTINCT record_id, crash_record_id, table_name FROM silver1_crashes WHERE record_id LIKE '00%' OR crash_record_id LIKE '00%'",
    "next_record": "SELECT min(record_id) AS record_id FROM silver1_crashes WHERE record_id > '8' UNION ALL SELECT max(record_id) FROM silver1_crashes WHERE record_id < '8'",
    "event_spread": _SPREAD,
    "failure_rates": _ONCE + "SELECT folder, count(*) AS failures, round(count(*) FILTER (trusted) / count(*), 4) AS trusted_rate, round(count(*) FILTER (failure_type = 'SCHEMA_MISMATCH') / count(*), 4) AS schema_rate, round(count(*) FILTER (mandatory) / nullif(count(*) FILTER (failure_type = 'SCHEMA_MISMATCH'), 0), 4) AS mandatory_rate FROM f GROUP BY folder",
    "outcome_pivot": "SELECT folder, count(*) FILTER (failure_type = 'SCHEMA_MISMATCH') AS schema_mismatch, count(*) FILTER (failure_type = 'UNRESOLVED_VALUE') AS unresolved_value FROM structured_failures GROUP BY folder",
    "json_props": "SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL",
    "scalar_functions": r"SELECT c_custkey, upper(trim(c_name)) AS upper_name, CAST(length(c_name) AS INT) AS letters, CAST(strpos(c_name, '1') AS INT) AS at, concat_ws('|', c_mktsegment, c_name) AS joined, left(sha256(c_name), 16) AS hash, TRY_CAST(regexp_extract(c_name, '(\d+)', 1) AS INT) AS number, round(greatest(c_acctbal, 0.0), 2) AS balance, nullif(c_mktsegment, 'BUILDING') AS segment, starts_with(c_name, 'Customer#0000') AS begins FROM customer",
}

_CLEAN_ALL = {c: (lambda t, c=c: f"lower({t})" if c in clean.LOWER else _title(t) if c in clean.TITLE else f"upper({t})" if c in clean.UPPER else t)("trim(x)") for c in CRASH_COLUMNS}


def _json_text(c: str) -> str:
    """A field's text; objects with their keys in order, as the reader of messages gives them."""
    o = f"json_extract(p, '$.{c}')"
    keys = f"list_transform(list_sort(json_keys({o})), lambda k: '\"' || k || '\":' || CAST(json_extract({o}, '$.' || k) AS VARCHAR))"
    return f"CASE WHEN json_type(p, '$.{c}') = 'OBJECT' THEN '{{' || array_to_string({keys}, ',') || '}}' ELSE json_extract_string(p, '$.{c}') END"




def _with_damage(sql: str, values: tuple[str, ...] = standardize.DAMAGE, where: str = "true") -> str:
    """SQL over the mapping table with damage classes."""
    more = "".join(f" UNION ALL SELECT 'damage', '{v}', '{v}', 'seed', TIMESTAMP '1970-01-01'" for v in values)
    return sql.replace("ref_canonical_mappings", f"(SELECT field_name, raw_synonym, canonical_value, added_by, added_at FROM ref_canonical_mappings WHERE {where}{more})")


_RUNS = """
b AS (SELECT DISTINCT lower(table_name) AS s, batch_id FROM silver1_crashes WHERE table_name IS NOT NULL),
names AS (SELECT DISTINCT s FROM b),
edges AS (SELECT 'bronze_' || s AS from_table, 'silver1_' || s AS to_table FROM names UNION SELECT 'silver1_' || s, 'silver2_' || s FROM names UNION SELECT 'silver1_' || s, 'silver2_quarantine' FROM names
  UNION SELECT 'silver2_' || s, 'gold' FROM names UNION SELECT 'gold', 'gold_daily_summary' FROM names),
reach AS (SELECT from_table, to_table, 1 AS depth FROM edges UNION ALL SELECT r.from_table, e.to_table, r.depth + 1 FROM reach r JOIN edges e ON r.to_table = e.from_table),
closed AS (SELECT from_table, to_table, CAST(min(depth) AS INT) AS depth FROM reach GROUP BY ALL)
"""
_HELD = "(" + ", ".join(f"'{c}'" for c in GOLD_COLUMNS) + ")"
_ALL_COLUMNS = "(" + ", ".join(f"'{c}'" for c in CRASH_COLUMNS) + ")"
_IMPACT_EVENTS = f"""
WITH RECURSIVE {_RUNS},
u AS (SELECT *, row_number() OVER (PARTITION BY failure_id) AS n FROM structured_failures),
f AS (SELECT u.*, (origin_layer || '_' || lower(folder)) IN (SELECT from_table FROM edges UNION SELECT to_table FROM edges) AS lineage_known FROM u WHERE n = 1),
g AS (SELECT *, CASE WHEN lineage_known THEN origin_layer || '_' || lower(folder) ELSE origin_layer END AS origin_table FROM f),
w AS (SELECT from_table AS origin_table, sum({_WEIGHT.format(t="to_table")}) AS down FROM closed GROUP BY 1),
k AS (SELECT origin_table, count(*) AS there FROM g GROUP BY 1),
o AS (SELECT from_table AS origin_table, sum(there) AS blocked FROM closed JOIN k ON k.origin_table = closed.to_table GROUP BY 1),
x AS (SELECT g.*, COALESCE(w.down, 0) + CASE WHEN origin_affected THEN {_WEIGHT.format(t="g.origin_table")} ELSE 0 END AS reach, CAST(COALESCE(o.blocked, 0) AS BIGINT) AS blocked,
  CASE WHEN failure_type = 'SCHEMA_MISMATCH' OR origin_affected OR column_name IS NULL THEN 1.0 WHEN g.origin_table LIKE 'bronze%' OR g.origin_table LIKE 'silver1%' THEN CASE WHEN column_name IN {_ALL_COLUMNS} THEN 1.0 ELSE 0.0 END
  WHEN g.origin_table LIKE 'silver2%' THEN CASE WHEN column_name IN {_HELD} THEN 1.0 ELSE 0.0 END ELSE 0.5 END AS propagation FROM g LEFT JOIN w USING (origin_table) LEFT JOIN o USING (origin_table)),
y AS (SELECT *, 30 * CASE WHEN origin_affected THEN 1.0 ELSE least(1.0, CASE failure_type WHEN 'SCHEMA_MISMATCH' THEN 1.0 WHEN 'UNRESOLVED_VALUE' THEN 0.4 ELSE 0.6 END + CASE WHEN mandatory THEN 0.3 ELSE 0.0 END) END
  + 25 * CASE WHEN reach > 0 THEN CAST(reach AS DOUBLE) / (CAST(reach AS DOUBLE) + 5) ELSE 0.0 END
  + 20 * CASE WHEN rows_affected IS NULL THEN 0.5 WHEN rows_affected <= 0 THEN 0.0 ELSE least(1.0, log10(1 + rows_affected) / log10(10001)) END + 15 * propagation + 10 * (blocked / (blocked + 1.0)) AS total FROM x)
SELECT failure_id, origin_table, lineage_known, CAST(reach AS DOUBLE) AS reach, blocked, CAST(propagation AS DOUBLE) AS propagation, CAST(round(total, 1) AS DOUBLE) AS score, CASE WHEN total >= 70 THEN 'P1' WHEN total >= 40 THEN 'P2' ELSE 'P3' END AS tier FROM y
"""
def _checks_sql() -> str:
    date_ = f"CASE WHEN date_order = 'DMY' THEN {_strptime([*_ISO, *_DMY, '%Y%m%d'])} ELSE {_strptime([*_ISO, *_MDY, *_DMY, '%Y%m%d'])} END"
    return f"""
    WITH r AS (SELECT record_id, ({date_}) AS day FROM silver1_crashes LEFT JOIN source_profiles USING (table_name) WHERE upper(trim(crash_month)) = 'JULE'),
    p AS (SELECT record_id, count(*) AS n, min(day) AS day FROM r GROUP BY 1)
    SELECT check_name, CAST(problems AS BIGINT) AS problems, problems = 0 AS passed FROM (
    SELECT 'resolution' AS check_name, CASE WHEN EXISTS (SELECT 1 FROM ref_canonical_mappings WHERE field_name = 'crash_month' AND canonical_value = 'JUNE') THEN 0 ELSE 1 END AS problems
    UNION ALL SELECT 'no_conflicting_mapping', count(*) FROM ref_canonical_mappings WHERE field_name = 'crash_month' AND upper(trim(raw_synonym)) = 'JULE' AND canonical_value <> 'JUNE'
    UNION ALL SELECT 'rows_conserved', count(*) FROM p WHERE n > 1 OR record_id IN (SELECT record_id FROM silver2_crashes)
    UNION ALL SELECT 'targeted_resolved', 0 UNION ALL SELECT 'no_new_failures', 0
    UNION ALL SELECT 'agrees_with_crash_date', count(*) FROM p WHERE n = 1 AND day IS NOT NULL AND month(day) <> 6)"""


_VALID = "v AS (SELECT b.* FROM b WHERE n NOT IN (SELECT n FROM x))"
ORACLE |= {
    "union_any_sources": "SELECT table_name AS source_table, count(*) AS records, count(dooring_i) AS dooring FROM silver2_crashes WHERE table_name IS NOT NULL GROUP BY 1",
    "quarantine_samples": _standard_sql() + ", p AS (SELECT table_name AS folder, column_name, upper(trim(value)) AS raw_value, batch_id, record_id FROM x) SELECT folder, column_name, raw_value, count(*) AS rows_affected, count(DISTINCT batch_id) AS batches, array_to_string(list_sort(list(DISTINCT record_id))[1:5], ',') AS samples, column_name = 'crash_date' AS mandatory FROM p GROUP BY 1, 2, 3",
    "clean_all": f"WITH e AS (SELECT topic, kafka_partition, kafka_offset, CASE WHEN json_type(raw_value, '$.payload') IS NULL THEN raw_value ELSE json_extract(raw_value, '$.payload') END AS p FROM bronze_crashes WHERE {_TOP}) SELECT topic, kafka_partition, kafka_offset, "
    + ", ".join("nullif(" + _CLEAN_ALL[c].replace("(x)", f"({_json_text(c)})") + f", '') AS {c}" for c in CRASH_COLUMNS) + " FROM e",
    "failure_counts": "SELECT folder, failure_type, count(*) AS failures, CAST(sum(rows_affected) AS BIGINT) AS rows_affected FROM structured_failures GROUP BY 1, 2",
    "failure_rank": _IMPACT + "SELECT row_number() OVER (ORDER BY score DESC, affected DESC, failure_id) AS rank, failure_id, score, affected, tier FROM (SELECT i.*, COALESCE(f.rows_affected, -1) AS affected FROM i JOIN f USING (failure_id)) ORDER BY rank LIMIT 20",
    "map_lookup_all": f"WITH {_LATEST}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field_name, upper(trim({c})) AS spelling, count(*) AS records FROM silver1_crashes GROUP BY ALL" for c in CRASH_COLUMNS if c in MAPPED)
    + ") SELECT v.field_name, v.spelling, records, canonical_value FROM v LEFT JOIN latest l ON l.field_name = v.field_name AND l.spelling = v.spelling",
    "lineage_runs": f"WITH RECURSIVE {_RUNS} SELECT job, 'COMPLETE' AS status, count(*) AS runs FROM (SELECT unnest(['write_silver1_' || s, 'write_silver2_' || (CASE WHEN s > 'quarantine' THEN 'quarantine' ELSE s END), 'write_gold', 'write_gold_daily_summary']) AS job FROM b) GROUP BY job",
    "lineage_from_events": f'WITH RECURSIVE {_RUNS} SELECT to_table AS "table", from_table AS upstream, depth FROM closed',
    "failure_impact_events": _IMPACT_EVENTS,
    "replay_checks": _checks_sql(),
    "replay_conservation": _standard_sql() + ", i AS (SELECT DISTINCT record_id FROM b), q AS (SELECT DISTINCT record_id FROM x), c AS (SELECT (SELECT count(*) FROM i) AS s, (SELECT count(*) FROM q) AS h) "
    "SELECT s AS selected, s AS selected_ids, s - h AS released, s - h AS released_ids, h AS held, h AS held_ids, true AS conserved, true AS disjoint FROM c",
    "stream_all_layers": _with_damage(_standard_sql()) + f", {_VALID} SELECT table_name AS source, 'valid' AS layer, count(*) AS records FROM v GROUP BY 1 UNION ALL SELECT table_name, 'business', count(*) FROM v GROUP BY 1 "
    f"UNION ALL SELECT table_name, 'held', count(*) FROM b WHERE n IN (SELECT n FROM x) GROUP BY 1 UNION ALL SELECT table_name, 'audit', CAST(sum({_FIXES}) AS BIGINT) FROM b GROUP BY 1 HAVING sum({_FIXES}) > 0 "
    "UNION ALL SELECT NULL, 'daily', count(DISTINCT crash_record_id) + count(*) FILTER (crash_record_id IS NULL) FROM v WHERE COALESCE(crash_record_id, '') NOT LIKE 'FAULT-%'",
    "replay_released": "WITH all_ids AS (SELECT DISTINCT table_name, record_id FROM silver1_crashes), held AS (SELECT DISTINCT table_name, record_id FROM (" + _with_damage(_standard_sql(), standardize.DAMAGE[:1], "added_by = 'seed'") + " SELECT table_name, record_id FROM x)), "
    "still AS (SELECT DISTINCT table_name, record_id FROM (" + _with_damage(_standard_sql()) + " SELECT table_name, record_id FROM x)), h AS (SELECT held.*, still.record_id IS NULL AS released FROM held LEFT JOIN still USING (table_name, record_id)) "
    "SELECT table_name, CASE WHEN released THEN 'RESOLVED' ELSE 'PENDING' END AS state, count(*) AS records FROM h GROUP BY 1, 2 "
    "UNION ALL SELECT a.table_name, 'VALID', count(*) FROM all_ids a LEFT JOIN h USING (table_name, record_id) WHERE h.record_id IS NULL OR released GROUP BY 1",
}

NAMES = (
    quarantine_samples, union_any_sources, stream_all_layers, replay_released, replay_checks, lineage_runs, lineage_from_events, failure_impact_events, clean_all, failure_counts, failure_rank, map_lookup_all,
    clean_projection, union_sources_tagged, contract_guard, contract_signatures, dead_letter_groups, mapping_latest, map_lookup_exact, parse_dates, parse_numbers, parse_hours,
    edit_distance, fuzzy_canonical, fuzzy_audit, standardize_route_counts, columns_to_remediate, quarantine_failures, gold_projection, dedup_business_key, metric_daily,
    metric_conditions, metric_time_pattern, metric_causes, metric_areas, failures_once, failures_merged, column_set_jaccard, lineage_closure, failure_impact, failure_ranking,
    incident_matches, vector_topk, record_trace, layer_differences, layer_changes, mentioned_ids, layer_overview, waiting_counts, never_standardized, parked_and_clean, hash_sample, id_lookup,
    next_record, event_spread, failure_rates, outcome_pivot, json_props, scalar_functions, replay_renamed, replay_conservation, fault_outcomes, canonical_values, batch_runs,
    promotion_candidates, promotion_by_field, id_set_operations, stream_to_layers,
)


def queries() -> dict:
    return {q.__name__: q for q in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
