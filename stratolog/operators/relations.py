"""Joins and sets over events and objects.

The self-join on the event id is the only step whose size is not linear in the log (the square of an event's objects).  It is an ordinary equi-join, so
AQE splits hot events, and it is aggregated right away.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: With it the shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What queries shuffle meanwhile leaves the disks when each ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def settled(small: DataFrame) -> DataFrame:
    """The rows of a small result (types or activities squared), made now; what was shuffled for it leaves the disks before the next one is made."""
    with cleaned(small.sparkSession):
        rows = small.select("*").collect()
    return small.sparkSession.createDataFrame(rows, small.schema)


def typed(e2o: DataFrame, objects: DataFrame) -> DataFrame:
    return e2o.join(objects, "oid").select("eid", "oid", "otype")


def participants(typed_e2o: DataFrame, events: DataFrame) -> DataFrame:
    """Objects that occur in an event of the log."""
    return typed_e2o.join(events.select("eid"), "eid", "left_semi").select("oid", "otype").distinct()


def type_population(members: DataFrame) -> DataFrame:
    return members.groupBy("otype").agg(F.count(F.lit(1)).alias("population"))


def lifespan(events: DataFrame, typed_e2o: DataFrame) -> DataFrame:
    """First and last time of each object; events without a time count for nothing here."""
    timed = events.where("ts is not null").select("eid", "ts")
    return typed_e2o.join(timed, "eid").groupBy("oid").agg(F.min("ts").alias("t_min"), F.max("ts").alias("t_max"))


def pairs(events: DataFrame, typed_e2o: DataFrame) -> DataFrame:
    """activity, src, stype, dst, dtype: one row for each event and ordered pair of its objects, an object with itself included."""
    a = typed_e2o.join(events.select("eid", "activity"), "eid").select("eid", "activity", F.col("oid").alias("src"), F.col("otype").alias("stype"))
    b = typed_e2o.select("eid", F.col("oid").alias("dst"), F.col("otype").alias("dtype"))
    return a.join(b, "eid").drop("eid")


def cooccurrence(events: DataFrame, typed_e2o: DataFrame) -> DataFrame:
    """The reflexive, symmetric closure: src, stype, dst, dtype of all objects that share an event."""
    return pairs(events, typed_e2o).select("src", "stype", "dst", "dtype").distinct()


def meetings(events: DataFrame, typed_e2o: DataFrame) -> DataFrame:
    met = pairs(events, typed_e2o).where("stype <> dtype")
    return met.groupBy("activity", "src", "stype", "dst", "dtype").agg(F.count(F.lit(1)).alias("k"))


def explicit_edges(o2o: DataFrame, members: DataFrame) -> DataFrame:
    """Explicit edges between participants, both ways."""
    one = members.select(F.col("oid").alias("src"), F.col("otype").alias("stype"))
    two = members.select(F.col("oid").alias("dst"), F.col("otype").alias("dtype"))
    there = o2o.join(one, "src").join(two, "dst").select("src", "stype", "dst", "dtype")
    back = there.select(F.col("dst").alias("src"), F.col("dtype").alias("stype"), F.col("src").alias("dst"), F.col("stype").alias("dtype"))
    return there.unionByName(back).distinct()


def related(met: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Pairs of objects of different types that meet (``met``: src, stype, dst, dtype, repeats allowed) or have an explicit edge."""
    found = met.where("stype <> dtype").select("src", "stype", "dst", "dtype")
    if edges is not None:
        found = found.unionByName(edges.where("stype <> dtype"))
    return found.distinct()


def degrees(pairs_of_objects: DataFrame) -> DataFrame:
    return pairs_of_objects.groupBy("src", "stype", "dtype").agg(F.count(F.lit(1)).alias("degree"))


def degree_totals(degrees: DataFrame) -> DataFrame:
    """stype, dtype, pairs, sources of each ordered pair of types, from one row per object and partner type."""
    return degrees.groupBy("stype", "dtype").agg(F.sum("degree").alias("pairs"), F.count(F.lit(1)).alias("sources"))


def related_counts(one_way: DataFrame) -> DataFrame:
    """Pairs, sources and targets of each ordered pair of types, from ``degree_totals``; pairs go both ways, so targets are the sources the other way round."""
    none = F.lit(0).cast("long")
    own = F.struct("stype", "dtype", "pairs", "sources", none.alias("targets"))
    turned = F.struct(F.col("dtype").alias("stype"), F.col("stype").alias("dtype"), none.alias("pairs"), none.alias("sources"), F.col("sources").alias("targets"))
    both = one_way.select(F.explode(F.array(own, turned)).alias("x")).select("x.*")
    return both.groupBy("stype", "dtype").agg(*[F.sum(c).alias(c) for c in ("pairs", "sources", "targets")])
