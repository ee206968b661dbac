"""Every file form, the folder runner and the stream."""

import json
import sqlite3

import pytest

from stratolog.batch import analyse_folder, status_table
from stratolog.sources.files import read_log
from stratolog.streaming.lifespans import merge_lifespans, streaming_lifespan

EVENTS = [("e1", "place", "2024-01-01T10:00:00Z", ["o1", "i1", "i2"]), ("e2", "ship", "2024-01-02T10:00:00Z", ["i1"]), ("e3", "ship", "2024-01-03T10:00:00+00:00", ["i2"])]
OBJECTS = {"o1": "order", "i1": "item", "i2": "item"}


def write_all(folder):
    (folder / "sub").mkdir()
    relations = lambda ids: [{"objectId": o, "qualifier": "q"} for o in ids]
    (folder / "a.json").write_text(
        json.dumps(
            {
                "objectTypes": [],
                "eventTypes": [],
                "objects": [{"id": o, "type": t, "attributes": [], "relationships": relations(["i1"]) if o == "o1" else []} for o, t in OBJECTS.items()],
                "events": [{"id": e, "type": a, "time": ts, "relationships": relations(ids)} for e, a, ts, ids in EVENTS],
            },
            indent=1,
        )
    )
    (folder / "b.jsonocel").write_text(
        json.dumps(
            {
                "ocel:events": {e: {"ocel:activity": a, "ocel:timestamp": ts, "ocel:omap": ids, "ocel:vmap": {}} for e, a, ts, ids in EVENTS},
                "ocel:objects": {o: {"ocel:type": t, "ocel:ovmap": {}} for o, t in OBJECTS.items()},
            }
        )
    )
    links = lambda ids, tag: "<objects>" + "".join(f'<{tag} object-id="{o}" qualifier="q"/>' for o in ids) + "</objects>"
    (folder / "sub" / "c.XML").write_text(
        "<log><objects>"
        + "".join(f'<object id="{o}" type="{t}">{links(["i1"], "relationship") if o == "o1" else ""}</object>' for o, t in OBJECTS.items())
        + "</objects><events>"
        + "".join(f'<event id="{e}" type="{a}" time="{ts}">{links(ids, "relationship")}</event>' for e, a, ts, ids in EVENTS)
        + "</events></log>"
    )
    string = lambda k, v: f'<string key="{k}" value="{v}"/>'
    (folder / "d.xmlocel").write_text(
        "<log><events>"
        + "".join(f'<event>{string("id", e)}{string("activity", a)}<date key="timestamp" value="{ts}"/><list key="omap">{"".join(string("object-id", o) for o in ids)}</list></event>' for e, a, ts, ids in EVENTS)
        + "</events><objects>"
        + "".join(f'<object>{string("id", o)}{string("type", t)}</object>' for o, t in OBJECTS.items())
        + "</objects></log>"
    )
    (folder / "e.xes").write_text(
        "<log>"
        + "".join(f'<trace>{string("concept:name", c)}' + "".join(f'<event>{string("concept:name", a)}<date key="time:timestamp" value="{ts}"/></event>' for _, a, ts, _ in EVENTS) + "</trace>" for c in ("c1", "c2"))
        + "</log>"
    )
    db = sqlite3.connect(folder / "f.sqlite")
    db.executescript("""CREATE TABLE event (ocel_id TEXT, ocel_type TEXT); CREATE TABLE object (ocel_id TEXT, ocel_type TEXT); CREATE TABLE event_map_type (ocel_type TEXT, ocel_type_map TEXT);
        CREATE TABLE event_object (ocel_event_id TEXT, ocel_object_id TEXT, ocel_qualifier TEXT); CREATE TABLE object_object (ocel_source_id TEXT, ocel_target_id TEXT, ocel_qualifier TEXT);
        CREATE TABLE event_place (ocel_id TEXT, ocel_time TEXT); CREATE TABLE event_ship (ocel_id TEXT, ocel_time TEXT);""")
    for e, a, ts, ids in EVENTS:
        db.execute("INSERT INTO event VALUES (?, ?)", (e, a))
        db.execute(f"INSERT INTO event_{a} VALUES (?, ?)", (e, ts))
        db.executemany("INSERT INTO event_object VALUES (?, ?, 'q')", [(e, o) for o in ids])
    db.executemany("INSERT INTO object VALUES (?, ?)", OBJECTS.items())
    db.execute("INSERT INTO object_object VALUES ('o1', 'i1', 'q')")
    db.commit()
    db.close()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs")
    write_all(path)
    (path / "notes.txt").write_text("no log")
    (path / "broken.json").write_text('{"events": 5')
    return path


@pytest.mark.parametrize("name, edges", [("a.json", 1), ("b.jsonocel", 0), ("sub/c.XML", 1), ("d.xmlocel", 0), ("f.sqlite", 1)])
def test_forms(spark, folder, name, edges):
    log = read_log(spark, str(folder / name))
    events = {(r.eid, r.activity, str(r.ts)) for r in log.events.collect()}
    assert events == {(e, a, ts[:10] + " 10:00:00") for e, a, ts, _ in EVENTS}
    assert {(r.oid, r.otype) for r in log.objects.collect()} == set(OBJECTS.items())
    assert {(r.eid, r.oid) for r in log.e2o.collect()} == {(e, o) for e, _, _, ids in EVENTS for o in ids}
    assert [(r.src, r.dst) for r in log.o2o.collect()] == [("o1", "i1")] * edges


def test_xes(spark, folder):
    log = read_log(spark, str(folder / "e.xes"))
    assert log.object_types == ["case"] and log.events.count() == 6
    assert {r.oid for r in log.objects.collect()} == {"case:c1", "case:c2"}


def test_unknown_suffix(spark):
    with pytest.raises(ValueError, match="csv"):
        read_log(spark, "log.csv")


def test_folder(spark, folder, tmp_path):
    results = analyse_folder(spark, folder, tmp_path / "out")
    status = {r["input_path"].rsplit("/", 1)[1]: r["status"] for r in results}
    assert {k for k, v in status.items() if v == "ok"} >= {"a.json", "b.jsonocel", "c.XML", "d.xmlocel", "e.xes", "f.sqlite"}
    assert "notes.txt" not in status
    assert (tmp_path / "out" / "sub" / "c.html").read_text().startswith("<!DOCTYPE html>")
    table = status_table(spark, results)
    assert table.count() == len(results) and table.columns == ["input_path", "output_path", "status", "error"]
    flat = analyse_folder(spark, folder, tmp_path / "flat", recursive=False)
    assert len(flat) == len(results) - 1


def test_stream_of_lifespans(spark, tmp_path):
    schema = "eid string, ts timestamp_ntz, oid string, otype string"
    rows = [("e1", "2024-01-02", "a", "x"), ("e2", "2024-01-01", "a", "x"), ("e3", "2024-01-05", "b", "x")]
    batch = spark.createDataFrame(rows, "eid string, ts string, oid string, otype string").selectExpr("eid", "cast(ts as timestamp_ntz) ts", "oid", "otype")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = streaming_lifespan(stream).writeStream.outputMode("complete").format("memory").queryName("lifespans").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("lifespans")
    expected = streaming_lifespan(batch)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert sorted(map(tuple, merge_lifespans(got, expected).collect())) == sorted(map(tuple, expected.collect()))
