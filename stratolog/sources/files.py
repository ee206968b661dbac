"""Object-centric logs from files, by suffix: JSON, SQLite and XML forms of the public interchange formats, and XES with one case type.

Schemas are given, not inferred, so reading takes one pass.  Attributes and qualifiers are not read: no analysis uses them.
"""

from __future__ import annotations

from functools import reduce
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import Log
from .sqlite import SQLiteTable, tables

_PAIR = "struct<_key:string,_value:string>"


def _time(column: str) -> Column:
    """Local clock time of any ISO 8601 text in UTC; a text that is no time gives null."""
    return F.try_to_timestamp(F.col(column)).cast("timestamp_ntz")


def _json(spark: SparkSession, path: str) -> Log:
    relations = "relationships array<struct<objectId:string>>"
    schema = f"events array<struct<id:string,type:string,time:string,{relations.replace(' ', ':')}>>, objects array<struct<id:string,type:string,{relations.replace(' ', ':')}>>"
    root = spark.read.schema(schema).json(path, multiLine=True)
    events = root.select(F.explode("events").alias("e")).select("e.*")
    objects = root.select(F.explode("objects").alias("o")).select("o.*")
    e2o = events.select(F.col("id").alias("eid"), F.explode("relationships.objectId").alias("oid"))
    o2o = objects.select(F.col("id").alias("src"), F.explode("relationships.objectId").alias("dst"))
    return Log.from_tables(events.select(F.col("id").alias("eid"), F.col("type").alias("activity"), _time("time").alias("ts")), objects.select(F.col("id").alias("oid"), F.col("type").alias("otype")), e2o, o2o)


def _json_maps(spark: SparkSession, path: str) -> Log:
    event = "struct<`ocel:activity`:string,`ocel:timestamp`:string,`ocel:omap`:array<string>>"
    root = spark.read.schema(f"`ocel:events` map<string,{event}>, `ocel:objects` map<string,struct<`ocel:type`:string>>").json(path, multiLine=True)
    events = root.select(F.explode("`ocel:events`").alias("eid", "e")).select("eid", "e.*")
    objects = root.select(F.explode("`ocel:objects`").alias("oid", "o")).select("oid", F.col("o.`ocel:type`").alias("otype"))
    e2o = events.select("eid", F.explode("`ocel:omap`").alias("oid"))
    return Log.from_tables(events.select("eid", F.col("`ocel:activity`").alias("activity"), _time("`ocel:timestamp`").alias("ts")), objects, e2o)


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _xml(spark: SparkSession, path: str) -> Log:
    ends = "objects struct<relationship:array<struct<`_object-id`:string>>,object:array<struct<`_object-id`:string>>>"
    events = _rows(spark, path, "event", f"_id string, _type string, _time string, {ends}").where("_id is not null")
    objects = _rows(spark, path, "object", f"_id string, _type string, {ends}").where("_id is not null")
    none = F.array().cast("array<string>")
    partners = F.explode(F.concat(F.coalesce("objects.relationship.`_object-id`", none), F.coalesce("objects.object.`_object-id`", none)))
    e2o = events.select(F.col("_id").alias("eid"), partners.alias("oid"))
    o2o = objects.select(F.col("_id").alias("src"), partners.alias("dst"))
    return Log.from_tables(events.select(F.col("_id").alias("eid"), F.col("_type").alias("activity"), _time("_time").alias("ts")), objects.select(F.col("_id").alias("oid"), F.col("_type").alias("otype")), e2o, o2o)


def _value(column: str, key: str) -> Column:
    return F.filter(column, lambda x: x.getField("_key") == key)[0].getField("_value")


def _xml_keys(spark: SparkSession, path: str) -> Log:
    lists = f"list array<struct<_key:string,string:array<{_PAIR}>>>"
    events = _rows(spark, path, "event", f"string array<{_PAIR}>, date array<{_PAIR}>, {lists}")
    objects = _rows(spark, path, "object", f"string array<{_PAIR}>")
    events = events.select(_value("string", "id").alias("eid"), _value("string", "activity").alias("activity"), _value("date", "timestamp").alias("time"), F.filter("list", lambda x: x.getField("_key") == "omap")[0].getField("string").alias("omap"))
    e2o = events.select("eid", F.explode("omap._value").alias("oid"))
    objects = objects.select(_value("string", "id").alias("oid"), _value("string", "type").alias("otype"))
    return Log.from_tables(events.select("eid", "activity", _time("time").alias("ts")), objects, e2o)


def _xes(spark: SparkSession, path: str) -> Log:
    event = f"struct<string:array<{_PAIR}>,date:array<{_PAIR}>>"
    traces = _rows(spark, path, "trace", f"string array<{_PAIR}>, event array<{event}>")
    cases = traces.select(F.concat(F.lit("case:"), _value("string", "concept:name")).alias("oid"), F.posexplode("event").alias("at", "e"))
    rows = cases.select(F.concat_ws("#", "oid", F.lpad(F.col("at").cast("string"), 9, "0")).alias("eid"), "oid", F.col("e.string").alias("s"), F.col("e.date").alias("d"))
    rows = rows.select("eid", "oid", _value("s", "concept:name").alias("activity"), _value("d", "time:timestamp").alias("time"))
    return Log.from_tables(rows.select("eid", "activity", _time("time").alias("ts")), rows.select("oid", F.lit("case").alias("otype")).distinct(), rows.select("eid", "oid"))


def _sqlite(spark: SparkSession, path: str) -> Log:
    spark.dataSource.register(SQLiteTable)
    read = lambda table: spark.read.format("sqlite_table").option("path", path).option("table", table).load()
    kinds = read("event").select(F.col("ocel_id").alias("eid"), F.col("ocel_type").alias("activity"))
    timed = [t for t in tables(path) if t.startswith("event_") and t not in ("event_map_type", "event_object")]
    times = [read(t).select(F.col("ocel_id").alias("eid"), F.col("ocel_time").alias("time")) for t in timed]
    events = kinds.join(reduce(DataFrame.unionByName, times), "eid", "left") if times else kinds.withColumn("time", F.lit(None).cast("string"))
    objects = read("object").select(F.col("ocel_id").alias("oid"), F.col("ocel_type").alias("otype"))
    e2o = read("event_object").select(F.col("ocel_event_id").alias("eid"), F.col("ocel_object_id").alias("oid"))
    o2o = read("object_object").select(F.col("ocel_source_id").alias("src"), F.col("ocel_target_id").alias("dst"))
    return Log.from_tables(events.select("eid", "activity", _time("time").alias("ts")), objects, e2o, o2o)


READERS = {".json": _json, ".jsonocel": _json_maps, ".sqlite": _sqlite, ".xml": _xml, ".xmlocel": _xml_keys, ".xes": _xes}


def read_log(spark: SparkSession, path: str) -> Log:
    """The log in a file; its suffix, in either case, says which form it has."""
    suffix = PurePath(path).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix or path!r}; known: {', '.join(READERS)}")
    return READERS[suffix](spark, str(path))
