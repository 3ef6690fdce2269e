"""Replays, streams over tables, lineage, reuse of fixes, logs and CSV parts on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from lakewright.operators import audit, incidents, inspect, lineage, replay, standardize
from lakewright.session import fresh_path
from lakewright.sources import csv_files
from lakewright.sources.versioned import VersionedTable
from lakewright.streaming import layers
from lakewright.vocab import CRASH_COLUMNS

MAPPINGS = "field_name string, raw_synonym string, canonical_value string, added_by string, added_at timestamp"
META = {"record_id": "r", "batch_id": "1", "table_name": "A", "ingestion_ts": "2024-01-01", "topic": "t"}


def mappings(spark, *more):
    return spark.createDataFrame([("crash_month", "MAY", "MAY", "seed", None), ("damage", "OVER", "OVER", "seed", None), *more], MAPPINGS)


def crash(record_id, **values):
    return dict.fromkeys(CRASH_COLUMNS) | META | {"record_id": record_id, "crash_date": "2021-05-03", "crash_month": "MAY"} | values


def crashes(spark, *rows):
    columns = [*META, *CRASH_COLUMNS]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))


def tables(spark, *names):
    return [VersionedTable(spark, fresh_path(spark, n)) for n in names]


def hold(spark, ref, rows):
    done = standardize.standardize(rows, standardize.mapping_dict(ref), standardize.anchors(ref), day_first=F.lit(False))
    valid, held = tables(spark, "valid", "held")
    good, bad = standardize.route(done)
    valid.append(good)
    held.append(bad.drop("fuzzy_audit").withColumn("healing_status", F.lit("PENDING")))
    return valid, held


def test_replay_of_held_rows(spark):
    rows = crashes(spark, crash("a", crash_month="JUNNN"), crash("b", crash_month="JUNNN", damage="??"), crash("c"), crash("d", crash_month="junnn "), crash("d", crash_month="junnn "), crash("e", crash_month="ZZZ"))
    valid, held = hold(spark, mappings(spark), rows)
    assert valid.read().count() == 1 and held.read().count() == 5
    newer = mappings(spark, ("crash_month", "JUNNN", "JUNE", "x", None))
    audits = tables(spark, "audit")[0]
    run = lambda **k: replay.replay_quarantine(held, valid, newer, day_first=F.lit(False), audit=audits, **k)
    dry = run(column="crash_month", value=" junnn")
    assert (dry["selected"], dry["now_pass"], dry["still_failing_by_column"], dry["applied"]) == (4, 3, {"damage": 1}, False) and held.read().where("healing_status = 'PENDING'").count() == 5
    without = run(ids=spark.createDataFrame([("a",), ("d",)], "record_id string"), held=spark.createDataFrame([("a",)], "record_id string"))
    assert without["selected"] == 2 and without["replay_id"] != dry["replay_id"]
    done = run(column="crash_month", value="JUNNN", apply=True)
    assert (done["appended"], done["marked"], done["replay_id"]) == (2, 3, dry["replay_id"])
    assert sorted(r.record_id for r in valid.read().collect()) == ["a", "c", "d"] and {r.crash_month for r in valid.read().where("record_id <> 'c'").collect()} == {"JUNE"}
    assert sorted((r.record_id, r.healing_status) for r in held.read().collect()) == [("a", "RESOLVED"), ("b", "PENDING"), ("d", "RESOLVED"), ("d", "RESOLVED"), ("e", "PENDING")]
    assert run(apply=True)["now_pass"] == 0 and valid.read().count() == 3
    with pytest.raises(ValueError):
        replay.selection(held.read(), value="x")


def envelope(record_id, batch, **changes):
    fields = dict.fromkeys(CRASH_COLUMNS, "1") | changes
    return json.dumps({"record_id": record_id, "batch_id": batch, "table_name": "A", "ingestion_ts": "t", "payload": {k: v for k, v in fields.items() if v is not None}})


def test_replay_of_parked_batches(spark):
    rows = [(1, envelope("a", 1, damage=None, Damage="x")), (1, envelope("b", 1)), (2, envelope("c", 2, damage=None, Damage="x")), (2, envelope("d", 2, lane_cnt=None))]
    parked, loaded = tables(spark, "parked", "loaded")
    parked.append(spark.createDataFrame([(b, t, "t", None, "PENDING") for b, t in rows], "batch int, raw_value string, topic string, kafka_timestamp timestamp, healing_status string"))
    run = lambda apply: replay.replay_dead_letter(parked, loaded, ["batch"], rename={"Damage": "damage"}, apply=apply)
    assert {k: run(False)[k] for k in ("batches", "ready", "records")} == {"batches": 2, "ready": 1, "records": 4} and not loaded.exists()
    done = run(True)
    assert (done["appended"], done["marked"]) == (2, 2) and sorted(r.record_id for r in loaded.read().collect()) == ["a", "b"]  # batch 2 as a whole stays
    assert sorted((r.batch, r.healing_status) for r in parked.read().collect()) == [(1, "REPLAYED"), (1, "REPLAYED"), (2, "PENDING"), (2, "PENDING")]
    assert run(True)["ready"] == 0 and loaded.read().count() == 2


def test_checks(spark):
    staged = spark.createDataFrame([("a",), ("b",), ("c",), ("gone",)], "record_id string")
    rows = spark.createDataFrame([
        ("a", "PENDING", None, ["m"], {}, "MAY", "2021-05-01"), ("b", "PENDING", None, ["m"], {"m": "x", "damage": "y"}, None, "2021-06-01"), ("c", "RESOLVED", "other", ["m"], {}, "JUNE", None), ("extra", None, None, [], {}, "MAY", None),
    ], "record_id string, healing_status string, resolved_by string, before array<string>, after map<string,string>, value string, crash_date string")
    out = {r.check_name: (r.problems, r.passed) for r in replay.checks(staged, rows, staged.where("record_id = 'a'"), execution_id="e", column="m", raw_value="x", canonical="MAY", canonical_values=["MAY"], existing="JUNE").collect()}
    assert out == {"resolution": (0, True), "no_conflicting_mapping": (1, False), "rows_conserved": (4, False), "targeted_resolved": (2, False), "no_new_failures": (1, False)}
    month = {r.check_name: r.problems for r in replay.checks(staged, rows, staged.limit(0), execution_id="e", column="crash_month", raw_value="x", canonical="MAY", canonical_values=[]).collect()}
    assert (month["agrees_with_crash_date"], month["resolution"]) == (1, 1)


def test_streams_over_tables(spark, tmp_path):
    a, b, out, dead = tables(spark, "a", "b", "out", "dead")
    df = lambda *ids: spark.createDataFrame([(i,) for i in ids], "record_id string")
    got = []
    run = lambda skip=True: layers.follow(spark, [a, b], lambda rows, n: got.append((n, sorted(r.record_id for r in rows.collect()))), str(tmp_path / "cp"), "follow", skip_changes=skip).awaitTermination()
    a.append(df("1"))
    a.append(df("2"))
    b.append(df("3"))
    run()
    assert sorted(x for _, rows in got for x in rows) == ["1", "2", "3"]
    a.compact()
    a.append(df("4"))
    b.update(F.col("record_id") == "3", {"record_id": F.lit("5")})
    run()
    run()
    assert sorted(x for _, rows in got for x in rows) == ["1", "2", "3", "4"]
    b.delete(F.col("record_id") == "5")
    with pytest.raises(Exception, match="changed"):
        run(False)
    valid, held, log, lost = tables(spark, "v", "h", "l", "d")
    rows = crashes(spark, crash("a"), crash("b", crash_month="ZZZ"))
    handle = lambda ref: layers.to_standardized(valid, held, log, lost, ref, lambda x: x.withColumn("day_first", F.lit(False)), "s")
    handle(lambda: mappings(spark))(rows, 0)
    handle(lambda: mappings(spark))(rows, 0)  # delivered again
    handle(lambda: mappings(spark).select("nothing"))(rows, 1)
    assert [t.read().count() for t in (valid, held, lost)] == [1, 1, 2] and json.loads(lost.read().first().raw_json)["table_name"] == "A"


def test_two_writers_insert_a_key_once(spark):
    t = tables(spark, "merge")[0]
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), (None, 3)], "k string, v int")
    assert t.merge_missing(rows, ["k"]) == 3
    put, raced = t.manifest.put, []

    def late(version, state):
        if not raced:
            raced.append(True)
            VersionedTable(spark, t.path).append(spark.createDataFrame([("c", 9)], "k string, v int"))
        return put(version, state)

    t.manifest.put = late
    assert t.merge_missing(spark.createDataFrame([("c", 1), ("d", 1)], "k string, v int"), ["k"]) == 1
    assert sorted((r.k or "", r.v) for r in t.read().collect()) == [("", 3), ("a", 1), ("b", 2), ("c", 9), ("d", 1)]
    t.manifest.put = put
    assert t.update_matching(spark.createDataFrame([("a",), (None,), ("zz",)], "k string"), {"v": F.lit(7)}, F.col("v") < 3) == 1
    assert t.read().where("v = 7").first().k == "a"


def test_closure_of_a_layered_graph(spark):
    edges = [(f"t{layer}_{i}", f"t{layer + 1}_{j}") for layer in range(9) for i in range(4) for j in range(4)]
    out = lineage.closure(spark.createDataFrame([*edges, ("t9_0", "t0_0"), (None, "x")], "from_table string, to_table string"))
    depth = {(r.from_table, r.to_table): r.depth for r in out.collect()}
    assert depth["t0_1", "t9_2"] == 9 and depth["t9_0", "t3_1"] == 4 and ("t0_0", "t0_0") not in depth


def test_impact_from_events(spark):
    field = lambda names: {"schema": {"fields": [{"name": n, "type": "string"} for n in names]}}
    event = lambda at, i, o, names: json.dumps({"eventType": "COMPLETE", "eventTime": at, "run": {"runId": at}, "job": {"name": "j"}, "inputs": [{"name": f"/d/{i}"}], "outputs": [{"name": f"/d/{o}", "facets": field(names)}]})
    lines = [event("1", "silver1_a", "silver2_a", ["x", "y"]), event("2", "silver2_a", "gold", ["x", "y"]), event("3", "silver2_a", "gold", ["x"]), json.dumps({"eventType": "ODD"})]
    events = lineage.read_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    versions = {r.table: r.columns for r in lineage.schema_versions(events).collect()}
    assert versions == {"silver2_a": ["x", "y"], "gold": ["x"]}
    rows = [("1", "silver1", "A", "y"), ("2", "silver2", "A", "y"), ("3", "silver2", "A", "x"), ("4", "silver1", "B", "y"), ("5", "other", None, "y")]
    df = spark.createDataFrame([(i, layer, f, c, "UNRESOLVED_VALUE", 10, False, False) for i, layer, f, c in rows], "failure_id string, origin_layer string, folder string, column_name string, failure_type string, rows_affected long, mandatory boolean, origin_affected boolean")
    got = {r.failure_id: r for r in lineage.impact_by_lineage(df, lineage.feeds(events), lineage.schema_versions(events)).collect()}
    assert [(got[k].origin_table, got[k].lineage_known, got[k].propagation) for k in "12345"] == [("silver1_a", True, 1.0), ("silver2_a", True, 0.0), ("silver2_a", True, 1.0), ("silver1", False, 0.5), ("other", False, 0.5)]
    assert got["4"].reach == 8.0 and got["1"].reach == 8.0 and got["5"].reach == 0.0 and got["1"].blocked == 2


def test_reuse_of_fixes(spark):
    past = spark.createDataFrame([
        ("i1", "t", "m", "JULE", "MAP", "JULY", "SUCCESS", True, True, 3), ("i2", "t", "m", "jule ", "MAP", "JULY", "SUCCESS", True, False, 1), ("i3", "t", "m", "MA", "MAP", "MAY", "SUCCESS", True, False, 1), ("i4", "t", "m", "MA", "MAP", "MARCH", "SUCCESS", True, False, 2),
        ("i5", "t", "m", "XX", "MANUAL", None, "SUCCESS", True, False, 2), ("i6", "t", "m", "JU-NE", "MAP", "JUNE", "SUCCESS", True, False, 2), ("i7", "t", "m", "ju ne", "MAP", "JUNE", "FAILED", True, False, 2), ("i8", "t", "m", "QQ", "MAP", "X", "SUCCESS", False, False, 2),
    ], "incident_id string, table_name string, column_name string, raw_value string, action string, action_params string, outcome string, verified boolean, borrowed boolean, resolved_at int")
    fails = spark.createDataFrame([(v, "UNRESOLVED_VALUE", "t", "m", v, v != "Jule2") for v in ("Jule", "Jule2", "MA", "XX", "JU NE", "JULEE", "QQ", "JU/NE")], "signature_id string, failure_type string, table_name string, column_name string, raw_value string, trusted boolean")
    near = spark.createDataFrame([("Jule2", "i2", 0.95), ("JU NE", "i6", 0.97), ("JULEE", "i2", 0.93), ("QQ", "i8", 0.99), ("JU/NE", "i6", 0.7)], "signature_id string, incident_id string, score double")
    got = {r.signature_id: (r.incident_id, r.matched_by, r.reusable, r.reason) for r in incidents.decide(fails, near, past).collect()}
    assert got == {
        "Jule": ("i2", "EXACT", True, "exact signature"), "Jule2": ("i2", "STRUCTURED", False, "classification needs review"), "MA": ("i4", "EXACT", False, "past fixes disagree"), "XX": ("i5", "EXACT", False, "fixed by hand"),
        "JU NE": ("i6", "STRUCTURED", False, "this fix failed before"), "JULEE": ("i2", "STRUCTURED", False, "similar value only"), "QQ": (None, None, False, "no verified incident"), "JU/NE": ("i6", "STRUCTURED", False, "below threshold"),
    }


def test_log_of_repairs(spark):
    log = spark.createDataFrame([("e1", "f", "FAILED", 1, ["a"]), ("e1", "f", "SUCCESS", 2, ["a", "b"]), ("e1", "f", "SUCCESS", 3, ["z"]), ("e2", "g", "SUCCESS", 4, ["b"]), ("e3", "g", "FAILED", 5, None)], "execution_id string, failure_id string, status string, executed_at int, record_ids array<string>")
    assert [r.executed_at for r in audit.attempts(log, execution_id="e1").collect()] == [1, 2, 3] and audit.attempts(log, failure_id="g").count() == 2
    assert {(r.execution_id, r.executed_at) for r in audit.first_success(log).collect()} == {("e1", 2), ("e2", 4)}
    assert [r.executed_at for r in audit.latest(log, 2).collect()] == [5, 4]
    assert {(r.record_id, r.execution_id) for r in audit.record_executions(log).collect()} == {("a", "e1"), ("b", "e2"), ("z", "e1")}
    waiting = spark.createDataFrame([("a", "PENDING"), ("b", "RESOLVED"), ("q", "PENDING")], "record_id string, healing_status string")
    assert [tuple(r) for r in audit.held(log, waiting).collect()] == [("a", "e1")]
    assert {(r.failure_id, r.executed_at) for r in audit.newest_per(log, ["failure_id"], "executed_at").collect()} == {("f", 3), ("g", 5)}


def test_csv_parts(spark, tmp_path):
    for name, text in (("part10.csv", "a,b\n10,x\n"), ("part2.csv", 'b,a\n"two\nlines",2\n,3\n'), ("skip.csv", "a,b\n0,0\n"), ("note.txt", "")):
        (tmp_path / name).write_text(text)
    (tmp_path / "crash2").mkdir()
    (tmp_path / "crash10").mkdir()
    files = csv_files.part_files(spark, str(tmp_path), allow=["part10.csv", "part2.csv"])
    assert [f.rsplit("/", 1)[1] for f in files] == ["part2.csv", "part10.csv"] and csv_files.discovered(spark, str(tmp_path)) == ["crash2", "crash10"]
    rows = csv_files.scan(spark, files, ["a", "b", "c"])
    assert [tuple(r) for r in rows.orderBy("part", "a").collect()] == [(0, "2", "two\nlines", None), (0, "3", None, None), (1, "10", "x", None)]
    other = spark.createDataFrame([(0, str(k)) for k in range(5)], "part int, a string")
    mixed = csv_files.batches({"x": rows, "y": other}, 2)
    count = lambda df: sorted((r.table_name, r.batch_id, r["count"]) for r in df.groupBy("table_name", "batch_id").count().collect())
    assert count(mixed) == [("x", 0, 2), ("x", 1, 1), ("y", 0, 2), ("y", 1, 2), ("y", 2, 1)]
    assert count(csv_files.batches({"x": rows, "y": other}, 2, interleaved=False)) == [("x", 0, 2), ("x", 1, 1), ("y", 2, 2), ("y", 3, 2), ("y", 4, 1)]
    assert csv_files.scan(spark, [], ["a"]).count() == 0


def test_sql_over_frames_and_backfill(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert inspect.sql_over(spark, "SELECT sum(a) AS s FROM {rows}", rows=df).first().s == 3
    out = inspect.backfill(df, {"b": F.col("a").cast("string"), "c": F.col("a") * 2}).orderBy("a").collect()
    assert [(r.b, r.c) for r in out] == [("1", 2), ("x", 4)]
