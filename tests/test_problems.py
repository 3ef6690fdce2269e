"""The general data-processing operators against plain Python, with nulls, ties, repeats, empty tables and clashing names."""

import csv
import io
import json
import random
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewright.operators import bad_rows, drift, late_events, once, timestamps
from lakewright.session import fresh_path
from lakewright.vocab import CRASH_COLUMNS

LATE = dict(record_id="record_id", source="table_name", period="crash_date", arrived="ingestion_ts")
SCHEMA = "record_id string, table_name string, crash_date string, ingestion_ts string, day int, outcome string"


def late_rows(n=300, seed=1):
    r, rows = random.Random(seed), []
    for k in range(n):
        at = datetime(2020, 1, 1, tzinfo=timezone.utc) + timedelta(hours=r.randrange(800))
        day = (at - timedelta(days=r.choice([0, 0, 1, 2, 3, 10, 14, 15, 16, 30]))).date()
        rows.append((f"r{k}", r.choice("AAAAB"), day.isoformat(), at.isoformat(), 7, "x"))
        if k % 5 == 0:
            rows.append((f"r{k}", rows[-1][1], rows[-1][2], (at + timedelta(days=3)).isoformat(), None, None))
    return rows + [rows[0], (None, "A", "2020-01-01", "2020-01-01T00:00:00+00:00", 1, ""), ("n1", None, "2020-01-01", "2020-01-01", 1, ""), ("n2", "A", None, "2020-01-01", 1, ""), ("n3", "A", "junk", "junk", 1, "")]


def late_expected(rows):
    first = {}
    for rid, src, day, at, *_ in rows:
        try:
            entry = (datetime.fromisoformat(at).astimezone(timezone.utc), date.fromisoformat(day), src)
        except (TypeError, ValueError):
            continue
        if rid and src:
            first[rid] = min(first.get(rid, entry), entry)
    out = {}
    for rid, (at, day, src) in first.items():
        ahead = max((d for a, d, s in first.values() if s == src and a < at), default=day)
        gap = (ahead - day).days
        out[rid] = "too_late" if gap > 14 else "corrects" if gap >= 2 else "on_time"
    return out


def test_late_events(spark):
    rows = late_rows()
    found = {r.record_id: r.outcome for r in late_events.classify(spark.createDataFrame(rows, SCHEMA), **LATE).collect()}
    assert found == late_expected(rows)
    assert set(found.values()) == {"on_time", "corrects", "too_late"}


def in_state(spark, name):
    return late_events.LateState(spark, fresh_path(spark, name), shards=2)


def counts(state):
    return sorted((r.source, r.day, r.n) for r in state.counters().where("n > 0").collect())


def expected_counts(rows):
    entry, first, total = late_expected(rows), {}, {}
    for rid, src, day, at, *_ in rows:
        if rid in entry and src:
            first[rid] = min(first.get(rid, (at, day, src)), (at, day, src))
    for rid, (_, day, src) in first.items():
        if entry[rid] != "too_late":
            key = (src, (date.fromisoformat(day) - date(1970, 1, 1)).days)
            total[key] = total.get(key, 0) + 1
    return sorted((*k, n) for k, n in total.items())


def test_batches_in_any_order_give_the_counts_of_one_run(spark):
    """Three separately computed batches, retried and out of order; records re-sent in others, some under another day or earlier."""
    rows = [r for r in late_rows() if r[0] and r[1] and r[2] and "junk" not in r[:4]]
    rows += [(rows[5][0], rows[5][1], "2020-01-20", "2020-02-20T00:00:00+00:00", 1, ""), (rows[9][0], rows[9][1], "2019-12-25", "2019-12-30T00:00:00+00:00", 1, ""), ("ahead", "A", "2020-03-30", "2020-01-01T00:00:01+00:00", 1, ""), ("ahead", "A", "2020-01-01", "2020-01-01T00:00:00+00:00", 1, "")]
    batches = [rows[:120] + [rows[-1]], rows[120:250] + [rows[3]], rows[250:-1] + rows[100:110]]
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    want = expected_counts(rows)
    for order in ((0, 1, 2, 0), (2, 0, 2, 1)):
        state = in_state(spark, "test-late")
        assert [state.apply(frames[k], f"b{k}", **LATE) for k in order].count(False) == 1
        assert counts(state) == want
    assert {r.record_id: r.outcome for r in state.outcomes().collect()} == late_expected(rows)
    other = in_state(spark, "test-late-other")
    other.apply(frames[1], "b1", **LATE)
    both = in_state(spark, "test-late-both")
    both.apply(frames[0].unionByName(frames[2]), "b02", **LATE)
    assert both.absorb(other.arrivals(), "other") and not both.absorb(other.arrivals(), "other")
    assert counts(both) == want


def test_counters_merge_by_version(spark):
    outcomes = late_events.classify(spark.createDataFrame(late_rows(), SCHEMA), **LATE)
    old, new = late_events.counted(outcomes.limit(40), 1), late_events.counted(outcomes, 2)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(late_events.merge(old, new, new)) == key(late_events.merge(new, old)) == key(late_events.merge(new))
    total = list(late_expected(late_rows()).values())
    assert sum(r.n for r in late_events.period_totals(new).collect()) == total.count("on_time") + total.count("corrects")


def test_late_events_of_nothing(spark):
    assert late_events.classify(spark.createDataFrame([], SCHEMA), **LATE).count() == 0


def good_record(r):
    values = {c: r.choice(["", "x", 'say "hi"', "a,b", "two\nlines", "Ünïcode"]) for c in CRASH_COLUMNS}
    values |= dict.fromkeys(bad_rows.WHOLE_NUMBER_COLUMNS, "7") | {"crash_date": "2020-02-29", "num_units": "2.0", "latitude": "-36.5", "longitude": " 103 "}
    return [values[c] for c in CRASH_COLUMNS]


def as_csv(fields):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(fields)
    return out.getvalue()


def grammar(text):
    """Fields by RFC 4180, or None if a quote is out of place: a plain automaton."""
    fields, at = [], 0
    while True:
        if text[at : at + 1] == '"':
            at, field = at + 1, ""
            while True:
                end = text.find('"', at)
                if end < 0:
                    return None
                field += text[at:end]
                if text[end + 1 : end + 2] != '"':
                    at = end + 1
                    break
                field, at = field + '"', end + 2
            if text[at : at + 1] not in ("", ","):
                return None
        else:
            end = text.find(",", at)
            field, at = (text[at:], len(text)) if end < 0 else (text[at:end], end)
            if '"' in field:
                return None
        fields.append(field)
        if at >= len(text):
            return fields
        at += 1


def test_bad_rows(spark):
    r, texts = random.Random(4), []
    for k in range(400):
        fields = good_record(r)
        text = as_csv(fields)
        match k % 10:
            case 1:
                text = text.replace(",", '",', 1)
            case 2:
                text = '"' + text
            case 3:
                text = text + ",extra"
            case 4:
                text = text.rsplit(",", 1)[0] if grammar(text.rsplit(",", 1)[0]) else text + ",a,b"
            case 5:
                text = text + '"tail'
            case 6:
                fields[CRASH_COLUMNS.index(r.choice(["crash_hour", "street_no", "latitude", "crash_date", "num_units"]))] = r.choice(["+5", "-200", "24.5.1", "2020-02-30", "abc"])
                text = as_csv(fields)
            case 7:
                text += r.choice(["\n", "\r\n"])
        texts.append(text)
    texts += ["", None, '"', '""', "," * 48, texts[0], "x" * 300_000, '"' + "y" * 300_000]
    df = spark.createDataFrame([(str(k), t, "old", 1) for k, t in enumerate(texts)], "record_id string, raw_value string, error_class string, fields int")
    found = {r.record_id: (r.error_class, r.fields) for r in bad_rows.classify(df).collect()}
    for k, text in enumerate(texts):
        kind, fields = found[str(k)]
        if text is None:
            assert (kind, fields) == (None, None)
            continue
        want = grammar(bad_rows.LINE_END.sub("", text))
        if want is None:
            assert kind == bad_rows.BROKEN, text[:200]
        elif len(want) != 49:
            assert kind == bad_rows.COUNT, text[:200]
        else:
            assert fields == want
            assert (kind is None) == (k % 10 != 6 or k >= 400), (k, kind)
    assert bad_rows.loaded(bad_rows.classify(df)).columns == ["record_id", *CRASH_COLUMNS]


@pytest.mark.parametrize(("column", "text", "ok"), [
    ("crash_hour", "23", True), ("crash_hour", "24", False), ("crash_hour", "-1", False), ("street_no", " 12 ", True), ("street_no", "1.0", False), ("street_no", "", True),
    ("latitude", "90", True), ("latitude", "90.1", False), ("longitude", "-180.0", True), ("num_units", "-1", False), ("num_units", "1e3", False), ("crash_date", "2021-02-29", False), ("crash_date", "2020-2-29", False),
])
def test_values(spark, column, text, ok):
    reader = bad_rows.CsvReader()
    done = reader.read([",".join("" if c != column else text for c in CRASH_COLUMNS)]).to_pylist()[0]
    assert (done["error_class"], done["bad_column"]) == ((None, None) if ok else (bad_rows.VALUE, column))


def test_reject_tables_decide():
    """Against the grammar, on random texts with quotes, commas, blanks and line breaks, in files of many records."""
    r = random.Random(8)
    texts = ["".join(r.choice(['"', '"', ",", ",", "a", " ", "\n", "\r", "7", "\0", "é"]) for _ in range(r.randrange(12))) for _ in range(6000)]
    got = bad_rows.CsvReader(("a", "b", "c")).read(texts).to_pylist()
    for text, row in zip(texts, got, strict=True):
        want = grammar(text)
        kind = bad_rows.BROKEN if want is None else bad_rows.COUNT if len(want) != 3 else None
        assert (row["error_class"], row["fields"]) == (kind, want if kind is None else None), text


def test_long_whole_numbers_and_typed_values():
    fields = {c: "" for c in CRASH_COLUMNS} | {"street_no": "9" * 60, "crash_hour": "007", "latitude": " 41.5 ", "crash_date": "2020-02-29"}
    row = bad_rows.CsvReader().read([",".join(fields.values())]).to_pylist()[0]
    assert row["error_class"] is None and row["typed"]["crash_hour"] == 7 and row["typed"]["latitude"] == 41.5 and row["typed"]["crash_date"] == date(2020, 2, 29) and row["typed"]["street_no"] is None


ARRIVAL = "id string, topic string, kafka_partition int, kafka_offset long, kafka_timestamp long, keep string"
POSITION, ORDER = ("topic", "kafka_partition", "kafka_offset"), ("kafka_timestamp", "topic", "kafka_partition", "kafka_offset")


def test_once_over_batches(spark):
    r = random.Random(2)
    rows = [(r.choice([None, "hot", "hot", *[f"id{k}" for k in range(60)]]), r.choice("ab"), r.randrange(2), k, k // 7, "") for k in range(400)]
    rows.append(rows[0])
    state, kept, seen = once.SeenState(spark, fresh_path(spark, "test-seen"), shards=3), [], set()
    for number, batch in enumerate([rows[:150], [], rows[150:300], rows[100:200], rows[300:]]):
        done = once.keep_once(spark.createDataFrame(batch, ARRIVAL), state, identifier="id", position=POSITION, order=ORDER, batch=str(number))
        got = done.collect()
        assert len(got) == sum(x[0] is not None for x in batch)
        want = {}
        for x in batch:
            if x[0] is not None and x[0] not in seen:
                want[x[0]] = min(want.get(x[0], x), x, key=lambda x: (x[4], x[1], x[2], x[3]))
        seen |= set(want)
        assert sorted({(g.topic, g.kafka_partition, g.kafka_offset) for g in got if g.keep}) == sorted(w[1:4] for w in want.values())
        kept += want
    assert len(kept) == len(set(kept)) == len(seen)
    again = once.keep_once(spark.createDataFrame(rows[:150], ARRIVAL), state, identifier="id", position=POSITION, order=ORDER, batch="0")
    assert again.where("keep").select("id").distinct().count() == len({x[0] for x in rows[:150]} - {None})
    codes = state.read("dictionary").collect()
    assert len({(c.shard, c.code) for c in codes}) == len(codes) == len(seen)


def test_once_with_overlapping_writers(spark):
    state = once.SeenState(spark, fresh_path(spark, "test-overlap"), shards=2)
    batch = lambda name, ids: once.Batch(spark.createDataFrame([(x, name, 0, k, k, "") for k, x in enumerate(ids)], ARRIVAL), state, identifier="id", position=POSITION, order=ORDER, batch=name)
    slow = batch("a", ["x", "y"]).prepare()
    quick = batch("a-b", ["x", "z"]).prepare().commit()
    kept = lambda df: sorted(r.id for r in df.where("keep").collect())
    assert kept(quick) == ["x", "z"]
    assert kept(slow.commit()) == ["y"]  # x was committed in between
    codes = state.read("dictionary").collect()
    assert len(codes) == 3 == len({(c.shard, c.code) for c in codes})
    assert kept(batch("a-b", ["x", "z"]).prepare().commit()) == ["x", "z"] and kept(batch("a", ["x", "y"]).prepare().commit()) == ["y"]
    assert kept(batch("c", ["x", "y", "z", "w"]).prepare().commit()) == ["w"]


def test_once_with_concurrent_threads(spark):
    from concurrent.futures import ThreadPoolExecutor

    state = once.SeenState(spark, fresh_path(spark, "test-threads"), shards=3)
    frames = [spark.createDataFrame([(f"i{(k * 7 + b) % 40}", str(b), 0, k, k, "") for k in range(30)], ARRIVAL) for b in range(4)]
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda b: [r.id for r in once.keep_once(frames[b], state, identifier="id", position=POSITION, order=ORDER, batch=str(b)).where("keep").collect()], range(4)))
    kept = [x for ids in done for x in ids]
    assert len(kept) == len(set(kept)) == len({r.id for f in frames for r in f.collect()})


def test_once_folds_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(once, "DICTIONARY_PARTS", 2)
    state = once.SeenState(spark, fresh_path(spark, "test-fold"), shards=1)
    for b in range(5):
        once.keep_once(spark.createDataFrame([(f"i{b}", "t", 0, b, b, ""), ("i0", "t", 0, 100 + b, b, "")], ARRIVAL), state, identifier="id", position=POSITION, order=ORDER)
    assert len(state.snapshot()[1]["dictionary"]["0"]) <= 2 and sorted(r.code for r in state.read("dictionary").collect()) == list(range(5))


def test_uuid_notations(spark):
    from pyspark.sql import functions as F

    from lakewright.sources.envelopes import uuid_hex

    u = "0ee9383f-f073-4dea-aca3-f7b362ce5c11"
    texts = [u, u.upper(), "{" + u + "}", f" {u} ", "urn:uuid:" + u, "URN:UUID:" + u.upper(), u.replace("-", ""), "{ " + u + " }"]
    df = spark.createDataFrame([(t,) for t in [*texts, u[:-1], "", None, "x" + u]], "t string").select(uuid_hex(F.col("t")).alias("h"))
    assert [r.h for r in df.collect()] == [u.replace("-", "")] * len(texts) + [None] * 4


@pytest.mark.parametrize(("text", "source", "day", "instant"), [
    ("2021-07-04", "C", "2021-07-04", "2021-07-04T05:00:00Z"), ("7/4/2021", "C", "2021-07-04", "2021-07-04T05:00:00Z"), ("7/4/2021", "M", "2021-04-07", "2021-04-06T22:00:00Z"),
    ("13/4/2021", "C", None, None), ("2021-02-30", "C", None, None), ("20210704T101112Z", "C", "2021-07-04", "2021-07-04T10:11:12Z"), ("2021-03-14 02:30:00", "C", None, None),
    ("2021-11-07 01:30", "C", "2021-11-07", "2021-11-07T06:30:00Z"), ("1625393472", "C", "2021-07-04", "2021-07-04T10:11:12Z"), ("1625393472999", "C", "2021-07-04", "2021-07-04T10:11:12Z"),
    ("Sun Jul 04 05:11:12 CDT 2021", "C", "2021-07-04", "2021-07-04T10:11:12Z"), ("Sun Jul 04 05:11:12 CEST 2021", "C", None, None), ("4th of July 2021", "M", "2021-07-04", "2021-07-03T22:00:00Z"),
    ("04-JUL-21", "C", "2021-07-04", "2021-07-04T05:00:00Z"), ("2021-07-04T23:00:00-03", "C", "2021-07-04", "2021-07-05T02:00:00Z"), ("2021-07-04 00:30:00+05:45", "C", "2021-07-03", "2021-07-03T18:45:00Z"),
    ("12:30", "C", None, None), ("", "C", None, None), ("2021-07-04 12:15:00 AM", "C", "2021-07-04", "2021-07-04T05:15:00Z"), ("2021-07-04 10:00:00", "?", None, None), ("2021-07-04", "?", "2021-07-04", None),
    ("1965-07-04 12:00", "C", "1965-07-04", "1965-07-04T17:00:00Z"), ("1944-07-04 12:00", "L", "1944-07-04", "1944-07-04T10:00:00Z"), ("1969-06-01 08:00", "N", "1969-06-01", "1969-06-01T12:00:00Z"),
    ("2105-07-04 12:00", "C", "2105-07-04", "2105-07-04T17:00:00Z"), ("20210704101112", "C", "2021-07-04", "2021-07-04T15:11:12Z"), ("0001-01-01 00:00", "U", "0001-01-01", "0001-01-01T00:00:00Z"), ("9999-12-31 23:59:59", "U", "9999-12-31", "9999-12-31T23:59:59Z"),
    ("Mon, 28 Feb 2022 05:27:24 GMT", "C", "2022-02-27", "2022-02-28T05:27:24Z"), ("99999999999999999999", "C", None, None), ("x" * 100_000, "C", None, None), ("2021-07-04T24:00:00Z", "C", None, None),
])
def test_written_times(text, source, day, instant):
    import pandas as pd

    known = {"C": ("America/Chicago", "MDY"), "M": ("Europe/Madrid", "DMY"), "L": ("Europe/London", "DMY"), "N": ("America/New_York", "MDY"), "U": ("UTC", "MDY")}
    got = timestamps.normal_texts(pd.Series([text, text]), pd.Series([source, source]), pd.Series([True, False]), known).tolist()
    assert got == [day or "UNRESOLVED", instant or "UNRESOLVED"]


def test_zone_arithmetic_agrees_with_the_library():
    import numpy as np

    r = random.Random(3)
    for zone in ("America/Chicago", "Europe/Madrid", "America/Phoenix", "Australia/Lord_Howe", "Asia/Kathmandu"):
        at = np.array(sorted(r.randrange(0, 2_000_000_000) for _ in range(300)), dtype=np.int64)
        local = timestamps.to_local(at, zone)
        want = [int(datetime.fromtimestamp(int(t), ZoneInfo(zone)).replace(tzinfo=timezone.utc).timestamp()) for t in at]
        assert local.tolist() == want
        back, found = timestamps.to_instant(local, zone)
        assert found.all() and (timestamps.to_local(back, zone) == local).all() and (back <= at).all()
    days = timestamps.days_from_civil(np.array([1970, 2000, 1, 9999]), np.array([1, 2, 1, 12]), np.array([1, 29, 1, 31]))
    assert days.tolist() == [(date(*x) - date(1970, 1, 1)).days for x in ((1970, 1, 1), (2000, 2, 29), (1, 1, 1), (9999, 12, 31))]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["America/Chicago", "Europe/London", "America/New_York", "Australia/Lord_Howe", "Africa/Casablanca", "Asia/Manila", "America/Sao_Paulo"]), st.datetimes(datetime(1900, 1, 1), datetime(2200, 1, 1)))
def test_any_local_time_agrees_with_the_library(zone, local):
    import numpy as np

    local = local.replace(microsecond=0)
    seconds = int((local - datetime(1970, 1, 1)).total_seconds())
    instant, showed = timestamps.to_instant(np.array([seconds]), zone)
    early = local.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
    exists = early.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == local
    assert bool(showed[0]) == exists
    if exists:
        assert int(instant[0]) == int((early - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds())
        assert timestamps.to_local(instant, zone).tolist() == [seconds]


def test_normalise_with_clashing_columns(spark):
    df = spark.createDataFrame([("r", "C", "7/4/2021", None, "a", "b"), ("r", None, None, "junk", "a", "b")], "record_id string, table_name string, crash_date string, ts string, value string, _source string")
    profiles = spark.createDataFrame([("C", "America/Chicago", "MDY"), (None, "UTC", "MDY")], "table_name string, time_zone string, date_order string")
    out = timestamps.normalise(df, profiles, day_fields=["crash_date"], instant_fields=["ts"])
    assert sorted(map(tuple, out.collect())) == [("r", "crash_date", "7/4/2021", "2021-07-04"), ("r", "ts", "junk", "UNRESOLVED")]
    assert timestamps.normalise(df.limit(0), profiles.limit(0), day_fields=["crash_date"], instant_fields=["ts"]).count() == 0


@pytest.mark.parametrize(("key", "column"), [
    ("crash_date", "crash_date"), ("CrashDate", "crash_date"), ("crashDate", "crash_date"), ("CRASH_DATE", "crash_date"), ("Crash Date", "crash_date"), ("crash-date", "crash_date"), ("crash.date", "crash_date"),
    ("src_crash_date", "crash_date"), ("crash_date_txt", "crash_date"), ("crash_date_v2", "crash_date"), ("date_crash", "crash_date"), ("cras_hour", "crash_hour"), ("num_unit", "num_units"), ("long", "longitude"),
    ("hit_and_run_flag", "hit_and_run_i"), ("i_run_and_hit", "hit_and_run_i"), ("inju_no_indi", "injuries_no_indication"), ("camera_ref", None), ("owner_county", None), ("crash", None), ("", None),
])
def test_key_names(key, column):
    assert drift.resolve_key(key) == column


def test_given_synonyms():
    assert drift.resolve_key("gps_y") is None and drift.resolve_key("gps_y", synonyms={"gps_y": "latitude"}) == "latitude"


def envelope(source, batch, change=None, nested=True, **meta):
    fields = {c: "" for c in CRASH_COLUMNS}
    (change or (lambda f: None))(fields)
    head = {"record_id": "x", "batch_id": batch, "table_name": source, "ingestion_ts": ""} | meta
    return json.dumps(head | ({"payload": fields} if nested else fields))


def test_drift(spark):
    rows = [
        envelope("A", 1), envelope("A", 1, lambda f: f.update(gps_y=f.pop("latitude"))), envelope("A", 2, lambda f: f.pop("damage")), envelope("B", 1, lambda f: f.update(crash_hour=3, extra={"a": 1}), nested=False),
        envelope("B", 2, lambda f: f.update(location={"x": 1}, street_no=None, lane_cnt=[1], dooring_i=True)), envelope("A", 1)[:-5], "[]", "", None, "null", envelope("A", 1) + " tail", '{"payload": 3, "table_name": "A", "batch_id": 1}',
        envelope("A", None), envelope(None, 3), envelope("A", 1),
    ]
    found, names = drift.changes(spark.createDataFrame([(r, "z") for r in rows], "raw_value string, envelope string"), synonyms={"gps_y": "latitude"})
    got = {tuple(r) for r in found.collect()}
    assert got == {
        ("A", 1, "renamed", "latitude", "gps_y"), ("A", 2, "removed", "damage", ""), ("B", 1, "retyped", "crash_hour", "number"), ("B", 1, "added", "extra", ""), ("B", 2, "retyped", "location", "object"),
        ("B", 2, "retyped", "lane_cnt", "array"), ("B", 2, "retyped", "dooring_i", "boolean"),
    }
    reports = spark.createDataFrame([("SCHEMA_MISMATCH", "A", "9", ["damage", "latitude"], ["src_damage", "what"]), ("SCHEMA_MISMATCH", "A", "9", None, None), ("OTHER", "A", "9", ["damage"], [])], "failure_type string, folder string, batch_id string, expected_only array<string>, source_only array<string>")
    told = {tuple(r) for r in drift.reported_changes(reports, names).collect()}
    assert told == {("A", 9, "renamed", "damage", "src_damage"), ("A", 9, "added", "what", ""), ("A", 9, "removed", "latitude", "")}
    assert [(r.seq, r.batch_id) for r in drift.logged(found.where("table_name = 'B'")).orderBy("seq").collect()] == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 2)]


def test_union_schema(spark, monkeypatch):
    rows = [
        envelope("A", 1, lambda f: f.update(damage="a", CrashHour="9", crash_hour="7", cameraRef=3)), envelope("A", 2, lambda f: f.update(damage=5, camera_ref=4.5, flag=True, note=[1])), envelope("B", 1, lambda f: f.update(src_damage="b") or f.pop("damage"), nested=False),
        envelope("B", 2, lambda f: f.update(Crash_Hour="8", damage=None, table=1, zone="z") or f.pop("crash_hour")), "junk",
    ]
    df = spark.createDataFrame([(r, 1) for r in rows], "raw_value string, vals int")
    out = drift.unified(df, *drift.read_headers(df))
    assert out.columns == [*drift.META, *CRASH_COLUMNS, "camera_ref", "flag", "note", "table", "zone", "more_fields"]
    assert dict(out.dtypes) | {"camera_ref": "double", "flag": "boolean", "note": "string", "damage": "string"} == dict(out.dtypes)
    got = {(r.table_name, r.batch_id): r for r in out.collect()}
    assert [got[k].damage for k in sorted(got)] == ["a", "5", "b", None] and [got[k].crash_hour for k in sorted(got)] == ["7", "", "", "8"]
    assert [got[k].camera_ref for k in sorted(got)] == [3.0, 4.5, None, None] and got["A", 2].note == "[1]" and got["A", 2].flag is True
    monkeypatch.setattr(drift, "ADDED_COLUMNS", 2)
    few = {(r.table_name, r.batch_id): r for r in drift.unified(df, *drift.read_headers(df)).collect()}
    assert few["B", 2].more_fields == {"table": "1", "zone": "z"} and few["A", 1].camera_ref == 3.0 and few["A", 1].more_fields == {}
    nothing = df.limit(0)
    assert drift.unified(nothing, *drift.read_headers(nothing)).count() == 0


def test_learned_names(spark):
    rows = [envelope("A", b, lambda f, b=b: f.update(mystery=f"PT {b}", noise="zzz") or f.pop("location")) for b in range(5)] + [envelope("B", b, lambda f, b=b: f.update(location=f"QU {b}")) for b in range(5)]
    df = spark.createDataFrame([(r,) for r in rows], "raw_value string")
    _, names = drift.read_headers(df)
    assert {r.key: r.column for r in names.where("key in ('mystery', 'noise')").collect()} == {"mystery": "location", "noise": None}


def test_learned_names_of_one_file(spark):
    """A single file tells by its values: sky is the weather, rev is nothing, though both stand for the same absent columns."""
    sky = ["CLEAR", "RAIN", "SNOW", "clear"]
    rows = [envelope("A", 1, lambda f, k=k: [f.pop(c) for c in ("weather_condition", "damage")] and f.update(sky=sky[k % 4], rev=f"REV {k}")) for k in range(20)]
    rows += [envelope("B", b, lambda f, b=b: f.update(weather_condition=sky[b % 3], damage=f"OVER {b}")) for b in range(9)]
    _, names = drift.read_headers(spark.createDataFrame([(r,) for r in rows], "raw_value string"))
    assert {r.key: r.column for r in names.where("key in ('sky', 'rev')").collect()} == {"sky": "weather_condition", "rev": None}


def test_lattice():
    kinds = drift.LATTICE
    for a in kinds:
        for b in kinds:
            assert drift.promote(a, b) == drift.promote(b, a)
            for c in kinds:
                assert drift.promote(drift.promote(a, b), c) == drift.promote(a, drift.promote(b, c))


def test_drift_of_nothing(spark):
    found, _ = drift.changes(spark.createDataFrame([], "raw_value string"))
    assert found.count() == 0


def test_types_of_keys_known_by_evidence(spark):
    rest = {c: "x" for c in CRASH_COLUMNS if c != "lane_cnt"}
    text = lambda batch, **more: json.dumps({"record_id": "r", "batch_id": batch, "table_name": "A", "payload": rest | more})
    df = spark.createDataFrame([(text(b, lane_cnt="12"),) for b in (1, 2, 3)] + [(text(b, zqx=12),) for b in (4, 5, 6)], "raw_value string")
    assert {r.field_name: r.kinds for r in drift.column_types(df).collect()}["lane_cnt"] == ["number", "string"]


def test_envelopes_with_white_space_around(spark):
    from lakewright.sources.envelopes import parsed

    rows = ['{"a": 1}' + end for end in ("", " ", "\n", "\r\n", "\t \n", "x", "\n{}")] + ['\n{"a": 1}\n', "\n", None]
    assert parsed(spark.createDataFrame([(r,) for r in rows], "raw string"), "raw").count() == 6
