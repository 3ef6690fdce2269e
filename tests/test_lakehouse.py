"""Operators of the layered pipeline: golden vectors, versioned tables, streams, and the SQL of every query."""

import json
import os
import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from lakewright.functions import distance
from lakewright.operators import clean, contract, failures, faults, gold, incidents, inspect, lineage, replay, standardize
from lakewright.session import fresh_path
from lakewright.sources.versioned import VersionedTable, wait_for
from lakewright.streaming import layers
from lakewright.vocab import CRASH_COLUMNS

DATA = "/root/testdata/sf0.001"

# Taxonomy of the golden vectors.
TAXONOMY = {
    "weather_condition": {"CLEAR": ["C", "CLEAR WEATHER"], "RAIN": ["R", "RAINY"], "SNOW": [], "FOG": [], "UNKNOWN": ["U", "NOT KNOWN"], "CLOUDY": ["CLOUDY/OVERCAST", "O", "OVERCAST"]},
    "lighting_condition": {"DAYLIGHT": ["D", "MORNING", "DAY"], "DARKNESS, LIGHTED ROAD": ["N, L", "NIGHT, LIGHTED", "NIGHT WITH LIGHT"], "DARKNESS": ["N", "NIGHT"], "DUSK": [], "DAWN": [], "UNKNOWN": ["U", "NOT KNOWN"]},
    "crash_month": {m: [m[:3], str(k)] for k, m in enumerate(("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER"), 1)},
    "crash_day_of_week": {w: [w[:3], w[:2], str(k)] for k, w in enumerate(("SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY"), 1)},
}


@pytest.fixture(scope="module")
def seeds(spark):
    rows = [(f, s, c, "seed", k) for f, m in TAXONOMY.items() for c, more in m.items() for k, s in enumerate([c, *more])]
    return spark.createDataFrame([*rows, ("crash_month", "JULE", "JULY", "llm", 9), ("crash_month", None, "MAY", "llm", 9)], "field_name string, raw_synonym string, canonical_value string, added_by string, added_at int")


@pytest.mark.parametrize(("a", "b", "d"), [("JUNE", "JUNE", 0), ("", "JUNE", 4), ("JUNE", "", 4), ("MARCHH", "MARCH", 1), ("OCTOBR", "OCTOBER", 1), ("JULE", "JUNE", 1), ("JUEN", "JUNE", 1), ("TEUSDAY", "TUESDAY", 1), ("CA", "ABC", 2)])
def test_distances(a, b, d):
    assert distance.damerau(a, b) == distance.damerau(b, a) == d


@settings(max_examples=200, deadline=None)
@given(st.text("ABC", max_size=7), st.text("ABC", max_size=7), st.text("ABC", max_size=7))
def test_distance_is_a_metric(a, b, c):
    d = distance.damerau
    assert (d(a, b) == 0) == (a == b) and d(a, b) == d(b, a) and d(a, c) <= d(a, b) + d(b, c) and d(a, b) <= distance.aligned(a, b)


@pytest.mark.parametrize(("field", "raw", "want"), [
    ("weather_condition", "Clear Weagher", "CLEAR"), ("weather_condition", "NOT KNWON", "UNKNOWN"), ("weather_condition", "Clqudy", "CLOUDY"), ("weather_condition", "Rriny", None), ("weather_condition", "OTHER", None),
    ("lighting_condition", "NIGHT WITH LIGHX", "DARKNESS, LIGHTED ROAD"), ("lighting_condition", "LIGHT", None), ("lighting_condition", "NIGHT, UNLIGHTED", None), ("lighting_condition", "NIGHT UNLIGHTED", None),
    ("crash_month", "MARHC", "MARCH"), ("crash_month", "Marchh", "MARCH"), ("crash_month", "  august  ", "AUGUST"), ("crash_month", "JUEN", None), ("crash_month", "JULE", None), ("crash_month", "JUNY", None), ("crash_month", "JU", None),
    ("crash_month", "MARY", None), ("crash_month", "Mayo", None), ("crash_month", "FEBR", None), ("crash_month", None, None), ("crash_day_of_week", "MOON", None), ("crash_day_of_week", "TUES", None),
])
def test_guarded_match(seeds, field, raw, want):
    found = standardize.guarded(raw, standardize.anchors(seeds)[field])
    assert (found and found[0]) == want


def test_dates(spark):
    day_first = [("01/03/2021", "2021-03-01"), ("24/02/2021", "2021-02-24"), ("9/5/2022", "2022-05-09"), ("2021-07-04", "2021-07-04"), ("01-03-2021", "2021-03-01"), ("02/24/2021", None), (None, None), ("", None)]
    month_first = [("01/03/2021", "2021-01-03"), ("25/12/2021", "2021-12-25"), ("2021/07/04", "2021-07-04"), ("01-03-2021", "2021-01-03"), ("25-12-2021", "2021-12-25")]
    for pairs, first in ((day_first, True), (month_first, False)):
        df = spark.createDataFrame([(a,) for a, _ in pairs], "a string").select(standardize.standard_date(F.col("a"), F.lit(first)).alias("d"))
        assert [r.d for r in df.collect()] == [b for _, b in pairs]
    times = spark.createDataFrame([("09/05/2023 07:42:00 PM", False), ("01/03/2021 17:22:00", True), ("2021-02-24T15:00:00.000", True), ("25/12/2021", False)], "a string, f boolean")
    assert [r.d for r in times.select(standardize.standard_time(F.col("a"), F.col("f")).alias("d")).collect()] == ["2023-09-05 19:42:00", "2021-03-01 17:22:00", "2021-02-24 15:00:00", None]
    hours = spark.createDataFrame([(x,) for x in ("14", "7 pm", "07:30", "7:05 AM", "24", "9.0", "junk", None, "007")], "a string")
    assert [r.h for r in hours.select(standardize.standard_hour(F.col("a"), F.lit(None).cast("string")).alias("h")).collect()] == ["14.00", "19.00", "07.00", "07.00", None, "09.00", None, None, "07.00"]


def record(**changes):
    return tuple((dict.fromkeys(CRASH_COLUMNS) | {"record_id": "r", "table_name": "A"} | changes)[c] for c in ("record_id", "table_name", *CRASH_COLUMNS))


def test_standardize(spark, seeds):
    rows = [record(record_id="1", crash_date="03/04/2021", posted_speed_limit=" 30 ", crash_hour="14", crash_month="3", crash_day_of_week="5", weather_condition="Clqudy"), record(record_id="2", crash_month="Mayo"), record(record_id="3", crash_date="2021-01-01", damage="", weather_condition="junk")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("record_id", "table_name", *CRASH_COLUMNS)))
    out = standardize.standardize(df, standardize.mapping_dict(seeds), standardize.anchors(seeds), day_first=F.lit(False))
    a, b, c = out.orderBy("record_id").collect()
    assert (a.crash_date, a.posted_speed_limit, a.crash_hour, a.crash_month, a.crash_day_of_week, a.weather_condition) == ("2021-03-04", 30, "14.00", "MARCH", "THURSDAY", "CLOUDY")
    assert a.columns_to_remediate == {} and [x.matched for x in a.fuzzy_audit] == ["CLOUDY"] and a.raw_record.weather_condition == "Clqudy"
    assert b.columns_to_remediate == {"crash_date": "MISSING_MANDATORY_VALUE", "crash_month": "Mayo"}
    assert c.columns_to_remediate == {"weather_condition": "junk"}
    valid, held = standardize.route(out)
    assert valid.count() == 1 and held.count() == 2
    checks = replay.conserved(df, valid, held).first()
    assert checks.conserved and checks.disjoint
    grouped = failures.from_quarantine(held.withColumn("batch_id", F.lit(1)))
    assert {(r.column_name, r.raw_value, r.rows_affected, r.mandatory) for r in grouped.collect()} == {("crash_date", "MISSING_MANDATORY_VALUE", 1, True), ("crash_month", "MAYO", 1, False), ("weather_condition", "JUNK", 1, False)}
    assert standardize.standardize(df.limit(0), {}, {}, day_first=F.lit(True)).count() == 0


def test_overlay():
    base = {"f": {"A": "X"}}
    assert standardize.overlay(base, {"f": {" b ": "Y", "": "Z"}, "g": {"c": "W"}}) == {"f": {"A": "X", "B": "Y"}, "g": {"C": "W"}} and base == {"f": {"A": "X"}}


def message(**changes):
    fields = dict.fromkeys(CRASH_COLUMNS, " x ") | changes
    return json.dumps({"record_id": "r", "batch_id": 1, "table_name": "A", "ingestion_ts": "t", "payload": {k: v for k, v in fields.items() if v is not None}})


def test_contract(spark):
    rows = [message(), message(damage=None), message(Damage="1"), message(damage=None, Damage="1"), '{"payload": 1}', "no json", None, json.dumps(dict.fromkeys(CRASH_COLUMNS, "1") | {"record_id": "q"})]
    out = contract.check(spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, raw_value string")).orderBy("k").collect()
    assert [r.error_class for r in out] == [None, "SCHEMA_MISMATCH", "SCHEMA_MISMATCH", "SCHEMA_MISMATCH", "CORRUPT_RECORD", "CORRUPT_RECORD", "CORRUPT_RECORD", None]
    assert (out[3].expected_only, out[3].source_only) == (["damage"], ["Damage"]) and len(out[5].expected_only) == 49
    lax = contract.check(spark.createDataFrame([(message(damage=None),)], "raw_value string"), optional=["damage"]).first()
    assert lax.error_class is None
    fixed = replay.renamed_batches(spark.createDataFrame([(1, message(damage=None, Damage="1")), (1, message()), (2, message(Damage="1"))], "b int, raw_value string"), ["b"], {"Damage": "damage"})
    assert {(r.b, r.records, r.passing, r.ready) for r in fixed.collect()} == {(1, 2, 2, True), (2, 1, 0, False)}


def test_clean(spark):
    df = spark.createDataFrame([(message(damage=" over ", street_name="main ST", prim_contributory_cause="ICE", crash_month=" May ", weather_condition="  "),)], "raw_value string")
    r = clean.clean(clean.unpack(df)).first()
    assert (r.damage, r.street_name, r.prim_contributory_cause, r.crash_month, r.weather_condition, r.batch_id) == ("OVER", "Main St", "ice", "May", None, 1)


def test_versioned_table(spark):
    t = VersionedTable(spark, fresh_path(spark, "table"))
    df = lambda *rows: spark.createDataFrame(rows, "id int, v string")
    with pytest.raises(TimeoutError):
        wait_for(t, timeout=0.1, poll=0.05)
    assert t.append(df((1, "a"), (2, "b")), app_id="x", batch=0) and not t.append(df((9, "z")), app_id="x", batch=0)
    assert t.append(df((3, "c")), app_id="y", batch=0)
    first = t.version()
    assert t.update(F.col("id") >= 2, {"v": F.upper("v")}) == 2 and sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(r.v for r in t.read(first).collect()) == ["a", "b", "c"]
    t.add_columns("extra double")
    assert [f.name for f in t.schema().fields] == ["id", "v", "extra"] and t.read().where("extra is null").count() == 3
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([("x", "y")], "id string, v string"))
    assert t.merge_missing(df((1, "n"), (4, "d"), (4, "d")), ["id"]) == 1 and t.delete(F.col("id") == 1) == 1
    t.compact()
    assert sorted(r.id for r in t.read().collect()) == [2, 3, 4]
    assert t.vacuum() and t.read().count() == 3 and t.history()[0]["operation"] == "compact"
    assert not t.manifest.put(t.version(), {})  # a version is written once
    t.overwrite(df())
    assert t.read().count() == 0


def test_streams_write_each_batch_once(spark, tmp_path):
    source = tmp_path / "in"
    schema = "kafka_key string, raw_value string, topic string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp"
    write = lambda texts: spark.createDataFrame([(None, t, "t", 0, k, None) for k, t in enumerate(texts)], schema).coalesce(1).write.mode("append").parquet(str(source))
    good, parked = (VersionedTable(spark, fresh_path(spark, n)) for n in ("good", "parked"))
    run = lambda: layers.start(layers.messages(spark, str(source)), layers.to_clean(good, parked, "s"), str(tmp_path / "cp"), "test").awaitTermination()
    write([message(), message(damage=None), "junk"])
    run()
    write([message()])
    run()
    run()
    assert good.read().count() == 2 and parked.read().count() == 2
    layers.to_clean(good, parked, "s")(spark.read.schema(schema).parquet(str(source)), 0)  # batch 0 again
    assert good.read().count() == 2 and parked.read().count() == 2


def test_business_keys(spark):
    rows = [("k", "2", False), ("k", "1", False), (None, "3", False), (None, "3", False), ("FAULT-1", "4", True), ("n", "5", None)]
    df = spark.createDataFrame(rows, "crash_record_id string, record_id string, is_injected boolean")
    assert sorted((r.crash_record_id or "", r.record_id) for r in gold.real_crashes(df).collect()) == [("", "3"), ("", "3"), ("k", "1"), ("n", "5")]


def test_lineage(spark):
    event = lambda kind, run, at, i, o: json.dumps({"eventType": kind, "eventTime": at, "run": {"runId": run}, "job": {"name": "j"}, "inputs": [{"name": x} for x in i], "outputs": [{"name": x} for x in o]})
    lines = [event("START", "1", "t1", ["/d/a"], ["/d/b"]), event("COMPLETE", "1", "t2", ["/d/a"], ["/d/b"]), event("RUNNING", "1", "t3", ["/d/a"], ["/d/b"]), event("START", "2", "t4", ["/d/b"], ["/d/c", "/d/a"]), "junk", event("START", "3", "t5", ["x"], [])]
    events = lineage.read_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {(r.run_id, r.status, r.started_at, r.ended_at, r.job) for r in lineage.runs(events).collect()} == {("1", "COMPLETE", "t1", "t2", "write_b"), ("2", "START", "t4", None, "write_a")}
    edges = lineage.feeds(events)
    assert {tuple(r) for r in edges.collect()} == {("a", "b"), ("b", "c"), ("b", "a")}
    assert {tuple(r) for r in lineage.closure(edges).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "c", 1)}


def test_failure_texts(spark):
    df = spark.createDataFrame([(["b", "a"], None)], "e array<string>, s array<string>").select(failures.schema_value(F.col("e"), F.col("s")).alias("v"))
    back = df.select(*failures.parse_schema_value(F.col("v"))).first()
    assert df.first().v == "EXPECTED_ONLY=a,b;SOURCE_ONLY=" and list(back) == [["a", "b"], []]
    names = spark.createDataFrame([("silver2_crash3",), ("/x/silver1_a/",), ("silver2_quarantine",), ("gold",), (None,)], "n string").select(*failures.split_table(F.col("n")))
    assert [tuple(r) for r in names.collect()] == [("silver2", "crash3"), ("silver1", "a"), (None, None), (None, None), (None, None)]


def test_similar_incidents(spark):
    schema = "signature_id string, failure_type string, column_name string, table_name string, layer string, raw_value string"
    new = spark.createDataFrame([("n", "UNRESOLVED_VALUE", "c", "t1", "silver2", "Jan."), ("e", "UNRESOLVED_VALUE", None, "t1", "silver2", None)], schema)
    old = spark.createDataFrame([("o1", "UNRESOLVED_VALUE", "c", "t1", "silver2", "JAN"), ("o2", "PARSE_ERROR", "c", "t2", "silver2", "JAM"), ("o3", "UNRESOLVED_VALUE", "d", "t1", "silver2", "JAN")], schema)
    assert [(r.incident_id, r.score) for r in incidents.similar(new, old).orderBy("rank").collect()] == [("o1", 1.0), ("o2", round(0.125 + 0.25 + 0.105 + 0.35 * 2 / 3, 4))]


def test_similar_schema_failures(spark, monkeypatch):
    schema = "signature_id string, failure_type string, column_name string, table_name string, layer string, raw_value string, expected_only array<string>, source_only array<string>"
    r, names = random.Random(3), "abcde"
    pick = lambda: r.choice([None, *([r.sample(names, n) for n in range(4)])])
    rows = [(f"s{k:02}", r.choice(["SCHEMA_MISMATCH", "SCHEMA_DRIFT", "MISSING_COLUMN"]), None, f"t{k % 3}", "silver1" if k % 3 else "bronze", None, pick(), pick()) for k in range(40)]
    rows += [("v1", "UNRESOLVED_VALUE", "c", "t1", "silver2", "JAN", None, None), ("v2", "UNRESOLVED_VALUE", "c", "t1", "silver2", "JAN.", None, None)]
    jaccard = lambda a, b: len(set(a or ()) & set(b or ())) / len(set(a or ()) | set(b or ())) if a or b else 1.0
    kind = lambda t: "SCHEMA_DRIFT" if t == "SCHEMA_MISMATCH" else t

    def score(f, i):
        value = (jaccard(f[6], i[6]) + jaccard(f[7], i[7])) / 2
        return 0.25 * (1 if kind(f[1]) == kind(i[1]) else 0.5) + 0.25 + 0.15 * (1 if f[3] == i[3] else 0.7 if f[4] == i[4] else 0) + 0.35 * value

    monkeypatch.setattr(incidents, "CHUNK", 9)
    df = spark.createDataFrame(rows, schema)
    got = {}
    for x in incidents.similar(df, df).orderBy("signature_id", "rank").collect():
        got.setdefault(x.signature_id, []).append((x.incident_id, x.score))
        assert x.reaches == (x.score >= 0.85)
    for f in rows[:40]:
        best = sorted((-int(score(f, i) * 10_000 + 0.5 + 1e-6), i[0]) for i in rows[:40] if i[0] != f[0])[:3]
        assert got[f[0]] == [(i, -s / 10_000) for s, i in best]
    assert got["v1"] == [("v2", 1.0)] and set(got) == {x[0] for x in rows}
    assert incidents.similar(df.limit(0), df).count() == incidents.similar(df, df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_all_failures_are_matched(spark):
    reports = spark.read.parquet(f"{DATA}/structured_failures.parquet")
    rows = failures.with_signature(reports).select("folder", "failure_type", "column_name", "signature_key").distinct().collect()
    rows = [r for r in rows if sum(r.column_name == x.column_name for x in rows) > 1]  # the others have nothing to be like
    assert {r.folder for r in rows if r.failure_type == "SCHEMA_MISMATCH"} == {"Crash1", "Crash2", "Crash3", "Crash4"}
    got = __spark_entry__.queries()["incident_matches"](spark, DATA)
    assert got.select("signature_id").distinct().count() == len(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_all_columns_of_all_layers_are_compared(spark, tmp_path):
    for name in ("bronze_crashes", "silver1_crashes", "silver2_crashes"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    base = dict.fromkeys(CRASH_COLUMNS, "x") | {"crash_hour": "07.00", "num_units": "2", "injuries_total": "1", "posted_speed_limit": "30", "hit_and_run_i": "true", "crash_date": "2021-01-01", "latitude": None, "longitude": None, "damage": None}
    add = lambda name, **row: spark.range(1).select(*(F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in spark.read.parquet(f"{DATA}/{name}.parquet").schema)).write.mode("append").parquet(str(tmp_path / f"{name}.parquet"))
    add("bronze_crashes", raw_value=message(**base | {"lane_cnt": "3", "alignment": " x ", "crash_hour": None, "hour_of_crash": "07.00"}))
    add("silver1_crashes", **base | {"record_id": "r", "batch_id": 1, "ingestion_ts": "t", "lane_cnt": "4", "report_type": ""})
    add("silver2_crashes", **base | {"record_id": "s", "batch_id": 1, "ingestion_ts": "t", "crash_hour": "07.00"})
    out = __spark_entry__.queries()["layer_changes"](spark, str(tmp_path)).collect()
    got = {(x.record_id, x.column_name): (x.bronze, x.silver1, x.silver2, x.gold) for x in out}
    assert got == {("r", "lane_cnt"): ("3", "4", None, None), ("s", "crash_hour"): (None, None, "07.00", "7"), ("s", "num_units"): (None, None, "2.0", "2")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_misspellings_of_every_field_are_promoted(spark, tmp_path):
    spark.read.parquet(f"{DATA}/ref_canonical_mappings.parquet").write.parquet(str(tmp_path / "ref_canonical_mappings.parquet"))
    values = {"weather_condition": "CLEARR", "lighting_condition": "DAYLIGHTT", "street_direction": None, "crash_month": "SEPTEMBERR", "crash_day_of_week": "THURSDAYY"}
    rows = [("A", k % 3, *values.values()) for k in range(5)] + [("A", 9, None, None, None, "OCTOBERR", None)] * 5
    spark.createDataFrame(rows, "table_name string, batch_id int, " + ", ".join(f"{c} string" for c in values)).write.parquet(str(tmp_path / "silver1_crashes.parquet"))
    got = {(r.field_name, r.value, r.canonical, r.records, r.batches) for r in __spark_entry__.queries()["promotion_by_field"](spark, str(tmp_path)).collect()}
    assert got == {("weather_condition", "CLEARR", "CLEAR", 5, 3), ("lighting_condition", "DAYLIGHTT", "DAYLIGHT", 5, 3), ("crash_month", "SEPTEMBERR", "SEPTEMBER", 5, 3), ("crash_day_of_week", "THURSDAYY", "THURSDAY", 5, 3)}


def test_spread(spark):
    r = random.Random(1)
    rows = [(g, float(r.randrange(20))) for g in "ab" for _ in range(r.randrange(1, 40))] + [("c", None)]
    got = {x.g: x for x in inspect.spread(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in "ab":
        v = sorted(x for k, x in rows if k == g)
        assert (got[g].n, got[g].max, got[g].p90) == (len(v), v[-1], v[round(0.9 * (len(v) - 1))])
        assert got[g].median == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert set(got) == {"a", "b"}


def test_faults_are_found(spark, seeds):
    rows = [record(record_id=str(k), crash_date="2021-01-01", crash_month="SEPTEMBER") for k in range(600)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("record_id", "table_name", *CRASH_COLUMNS)))
    done = standardize.standardize(faults.inject(df, "crash_month", every=2), standardize.mapping_dict(seeds), standardize.anchors(seeds), day_first=F.lit(False))
    out = {(r.fault, r.outcome): r.records for r in faults.outcomes(done, "crash_month").collect()}
    assert sum(out.values()) == 600 and not any(o == "WRONG_FIX" for _, o in out)
    assert {("typo", "FIXED"), ("unknown", "QUARANTINED"), ("missing", "EMPTY"), ("cut", "QUARANTINED"), ("none", "CLEAN")} <= set(out)


def test_nothing_imports_the_text_operators():
    for path in (Path(__file__).resolve().parent.parent / "lakewright").rglob("*.py"):
        if "llm" not in path.parts:
            assert "lakewright.llm" not in path.read_text()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["p1_found", "p4_found", "contract_guard", "metric_areas", "failure_impact", "record_trace"])
def test_queries_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for file in Path(DATA).glob("*.parquet"):
        db.execute(f"create view {file.stem} as select * from '{file}'")
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = db.execute(f"select {quoted} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    text = lambda rows: sorted(str([f"{x:.6g}" if isinstance(x, float) else str(x) for x in r]) for r in rows)
    assert text(map(tuple, df.select(*columns).collect())) == text(want)
