"""Traces of objects within layers: variants, directly-follows, starts and ends, arc multiplicities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relations import settled

#: Events of one object that a task takes as a whole.
BUSY = 100_000


def _order() -> tuple:
    """Events of an object are in order of time, then id; events without a time come last."""
    return F.col("ts").asc_nulls_last(), F.col("eid")


def object_variants(relations: DataFrame) -> DataFrame:
    """layer, otype, trace (activities, in order), objects: how many objects have that trace."""
    step = F.struct(F.col("ts").isNull().alias("late"), "ts", "eid", "activity")
    traces = relations.groupBy("layer", "otype", "oid").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    trace = F.transform("steps", lambda s: s.getField("activity"))
    return traces.select("layer", "otype", trace.alias("trace")).groupBy("layer", "otype", "trace").agg(F.count(F.lit(1)).alias("objects"))


def directly_follows(relations: DataFrame, busy: int = BUSY) -> DataFrame:
    """layer, otype, activity, follower, n.

    The trace of an object with more than ``busy`` events is cut into months, so that no task needs all of it; the last activity of one month is followed by
    the first of the next.  Months are in the order of time, so the counts do not depend on where a trace is cut.
    """
    keys = ["layer", "otype", "oid"]
    many = relations.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > busy).select(*keys, F.lit(True).alias("many"))
    month = F.when(F.col("many"), F.struct(F.col("ts").isNull().alias("late"), F.trunc("ts", "month").alias("month")))
    rows = relations.join(many, keys, "left").select(*keys, "activity", "ts", "eid", "many", month.alias("part"))
    within = rows.withColumn("follower", F.lead("activity").over(W.partitionBy(*keys, "part").orderBy(*_order())))
    rank = F.struct(F.col("ts").isNull().alias("late"), "ts", "eid")
    parts = rows.where("many").groupBy(*keys, "part").agg(F.min_by("activity", rank).alias("first"), F.max_by("activity", rank).alias("activity"))
    between = parts.withColumn("follower", F.lead("first").over(W.partitionBy(*keys).orderBy("part")))
    out = ["layer", "otype", "activity", "follower"]
    return within.select(*out).unionByName(between.select(*out)).where("follower is not null").groupBy(*out).agg(F.count(F.lit(1)).alias("n"))


def start_end_activities(relations: DataFrame) -> DataFrame:
    """layer, otype, activity, starts, ends: objects whose trace begins or ends there."""
    rank = F.struct(F.col("ts").isNull().alias("late"), "ts", "eid")
    ends = relations.groupBy("layer", "otype", "oid").agg(F.min_by("activity", rank).alias("first"), F.max_by("activity", rank).alias("last"))
    kinds = F.explode(F.array(F.struct(F.col("first").alias("activity"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("last").alias("activity"), F.lit(0).alias("s"), F.lit(1).alias("e"))))
    rows = ends.select("layer", "otype", kinds.alias("x")).groupBy("layer", "otype", "x.activity")
    return rows.agg(F.sum("x.s").alias("starts"), F.sum("x.e").alias("ends"))


def arc_multiplicity(relations: DataFrame, most: float = 0.0) -> DataFrame:
    """layer, otype, activity, events, single, variable: arcs are variable when more than ``most`` of the events hold other than one object of the type."""
    per_event = relations.groupBy("layer", "otype", "activity", "eid").agg(F.count(F.lit(1)).alias("objects"))
    rows = per_event.groupBy("layer", "otype", "activity").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("objects") == 1).alias("single"))
    return rows.withColumn("variable", F.col("events") - F.col("single") > F.col("events") * F.lit(most))


def flow_net(relations: DataFrame) -> DataFrame:
    """The net of the directly-follows graph: a place for each edge, one before each start and one after each end.

    layer, otype, place, activity, enters: whether the arc goes from the place to the activity.  The graph, activities squared, is found once and then
    held as rows.
    """
    edges = settled(directly_follows(relations)).select("layer", "otype", F.concat_ws(">", "activity", "follower").alias("place"), "activity", "follower")
    ends = settled(start_end_activities(relations))
    arc = lambda df, place, activity, enters: df.select("layer", "otype", F.concat(F.col("otype"), F.lit(":"), place).alias("place"), F.col(activity).alias("activity"), F.lit(enters).alias("enters"))
    return (
        arc(edges, F.col("place"), "activity", False)
        .unionByName(arc(edges, F.col("place"), "follower", True))
        .unionByName(arc(ends.where("starts > 0"), F.concat(F.lit(">"), "activity"), "activity", True))
        .unionByName(arc(ends.where("ends > 0"), F.concat(F.col("activity"), F.lit(">")), "activity", False))
    )


def place_graph(arcs: DataFrame) -> DataFrame:
    """layer, otype, place, successor: places that one activity leads to within a type."""
    into = arcs.where("enters").select("layer", "otype", "activity", "place")
    out = arcs.where("not enters").select("layer", "otype", "activity", F.col("place").alias("successor"))
    return into.join(out, ["layer", "otype", "activity"]).select("layer", "otype", "place", "successor").distinct()


def candidate_components(arcs: DataFrame, activity_layers: DataFrame) -> DataFrame:
    """layer, activity, component: activities below the layer that hang together through places of any type, named by the least of them.

    What is collected is at most the square of the number of activities, which a process has few of; the components are found on the driver.
    """
    from ..plans.miner import components

    inside = arcs.join(F.broadcast(settled(activity_layers)), "activity").where("activity_layer < layer").select("layer", "place", "activity").distinct()
    other = inside.withColumnRenamed("activity", "other")
    links: dict[int, list[tuple[str, str]]] = {}
    for layer, a, b in inside.join(other, ["layer", "place"]).where("activity <= other").select("layer", "activity", "other").distinct().collect():
        links.setdefault(layer, []).append((a, b))
    rows = [(layer, a, min(part)) for layer, pairs in sorted(links.items()) for part in components({x for p in pairs for x in p}, pairs) for a in sorted(part)]
    return arcs.sparkSession.createDataFrame(rows, "layer int, activity string, component string")
