"""What each layer sees of the log: all layers in one plan, with a ``layer`` column instead of a loop.

``layers`` is a DataFrame (otype, layer): one row per type, broadcast because a log has few types and the solver has already held their square in memory.
"""

from __future__ import annotations

from collections.abc import Sequence
from numbers import Integral

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import Log


def normalise_context(layers: Sequence[int], context: Sequence[int] | None) -> dict[int, int]:
    """How many layers below its own each layer looks at; 1 if nothing is said."""
    if context is None:
        return dict.fromkeys(layers, 1)
    if len(context) != len(layers):
        raise ValueError(f"layer_context has {len(context)} entries for {len(layers)} layers (lowest first)")
    for at, value in enumerate(context):
        if isinstance(value, bool) or not isinstance(value, Integral) or value < 0:
            raise ValueError(f"layer_context[{at}] must be a non-negative integer, not {value!r}")
    return {layer: int(value) for layer, value in zip(layers, context)}


def layer_frame(spark: SparkSession, solution: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(sorted(solution.items()), "otype string, layer int")


def layer_types(layers: DataFrame) -> DataFrame:
    return layers.groupBy("layer").agg(F.array_join(F.array_sort(F.collect_set("otype")), ",").alias("types"))


class LayerLogs:
    """Events, relations, objects, edges and resources of every layer."""

    def __init__(self, log: Log, layers: DataFrame, context: dict[int, int] | None = None):
        self.log, self.layers = log, layers
        spark = layers.sparkSession
        known = sorted(r[0] for r in layers.select("layer").distinct().collect())
        context = context or normalise_context(known, None)
        self.context = spark.createDataFrame([(k, context[k]) for k in known], "layer int, context int")

    def _own(self) -> DataFrame:
        """A type's row is small: the layers are broadcast."""
        return F.broadcast(self.layers.withColumnRenamed("layer", "own"))

    def activity_layer(self) -> DataFrame:
        """The lowest layer that an activity's events touch."""
        kinds = self.log.event_classes.select("activity", F.explode("kinds.otype").alias("otype")).distinct()
        return kinds.join(self._own(), "otype").groupBy("activity").agg(F.min("own").alias("activity_layer"))

    def layer_activities(self) -> DataFrame:
        """layer, activity, activity_layer of the activities that each layer looks at."""
        rows = self.activity_layer().join(F.broadcast(self.context), F.expr("activity_layer <= layer and layer - activity_layer <= context"))
        return rows.select("layer", "activity", "activity_layer")

    def _included(self) -> DataFrame:
        """layer, activity: as few rows as layers have activities, so that events never travel for them."""
        return F.broadcast(self.layer_activities().select("layer", "activity"))

    def relations(self) -> DataFrame:
        """layer, eid, activity, ts, oid, otype: selected events with their objects on that layer."""
        own = self.log.happenings.join(F.broadcast(self.layers), "otype")
        return own.join(self._included(), ["layer", "activity"]).select("layer", "eid", "activity", "ts", "oid", "otype")

    def _selected(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with activity and kinds) of each layer that looks at the activity and has objects in it."""
        solution = [F.lit(x) for r in self.layers.collect() for x in (r["otype"], r["layer"])]
        own = F.create_map(*solution) if solution else F.create_map().cast("map<string,int>")
        found = F.filter(F.array_distinct(F.transform("kinds", lambda k: F.element_at(own, k.getField("otype")))), lambda x: x.isNotNull())
        return rows.select("*", F.explode(found).alias("layer")).join(self._included(), ["layer", "activity"])

    def events(self) -> DataFrame:
        return self._selected(self.log.event_kinds).select("layer", "eid", "activity", F.explode("times.ts").alias("ts"))

    def objects(self) -> DataFrame:
        return self.relations().select("layer", "oid", "otype").distinct()

    def edges(self) -> DataFrame:
        """Explicit edges with both ends among a layer's objects."""
        used = self.objects().select("layer", "oid")
        sources = self.log.o2o.join(used.withColumnRenamed("oid", "src"), "src").select("layer", "src", "dst")
        return sources.join(used.withColumnRenamed("oid", "dst"), ["layer", "dst"], "left_semi").select("layer", "src", "dst")

    def resources(self, share: tuple[int, int] = (1, 2)) -> DataFrame:
        """layer, activity, otype, own: higher types present in at least ``share`` of the activity's included events."""
        events = self._selected(self.log.event_classes).withColumn("times", F.col("times") * F.col("events"))
        total = events.groupBy("layer", "activity").agg(F.sum("times").alias("n"))
        types = events.select("layer", "activity", "times", F.explode("kinds.otype").alias("otype"))
        types = types.groupBy("layer", "activity", "otype").agg(F.sum("times").alias("k"))
        higher = types.join(self._own(), "otype").where("own > layer")
        rows = higher.join(total, ["layer", "activity"])
        return rows.where(F.col("k") * share[1] >= F.col("n") * share[0]).select("layer", "activity", "otype", "own", "k", "n")

    def activity_resources(self) -> DataFrame:
        """layer, activity, resources: every included activity's resource types, highest layer first."""
        ranked = self.resources().groupBy("layer", "activity").agg(F.array_sort(F.collect_list(F.struct((-F.col("own")).alias("o"), "otype"))).alias("r"))
        included = self._selected(self.log.event_classes).select("layer", "activity").distinct()
        types = F.transform("r", lambda x: x.getField("otype"))
        return included.join(ranked, ["layer", "activity"], "left").select("layer", "activity", F.coalesce(types, F.array().cast("array<string>")).alias("resources"))

    def highlighted_activities(self) -> DataFrame:
        """Included activities whose own layer is exactly one below."""
        included = self._selected(self.log.event_classes).select("layer", "activity").distinct()
        return included.join(self.activity_layer(), "activity").where("activity_layer = layer - 1").select("layer", "activity")

    def arc_multiplicity(self) -> DataFrame:
        """As ``flows.arc_multiplicity`` of the relations, from the events' counts."""
        kinds = self.log.event_classes.select("activity", "times", "events", F.explode("kinds").alias("x")).select("activity", "x.otype", (F.col("x.n") * F.col("times")).alias("objects"), "events")
        rows = kinds.join(F.broadcast(self.layers), "otype").join(self._included(), ["layer", "activity"])
        rows = rows.groupBy("layer", "otype", "activity").agg(F.sum("events").alias("events"), F.sum(F.when(F.col("objects") == 1, F.col("events")).otherwise(0)).alias("single"))
        return rows.withColumn("variable", F.col("events") > F.col("single"))

    def write(self, folder: str) -> None:
        """The four frames of all layers as Parquet, partitioned by layer."""
        for name in ("events", "relations", "objects", "edges"):
            getattr(self, name)().write.mode("overwrite").partitionBy("layer").parquet(f"{folder}/{name}")
