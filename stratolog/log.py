"""The object-centric event log: four DataFrames, and the relations every analysis shares."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import relations


@dataclass(frozen=True, eq=False)
class Log:
    """events(eid, activity, ts), objects(oid, otype), e2o(eid, oid), o2o(src, dst).

    Shared relations are planned once per log and kept as plans; ``keep`` materialises them, ``release`` drops them again.  A log without
    explicit edges plans no step for them.  ``plans`` are a source's own ways to the same rows, by name.  With ``declared_types`` the types of objects without events count as well: their scores are zero.
    """

    events: DataFrame
    objects: DataFrame
    e2o: DataFrame
    o2o: DataFrame
    has_edges: bool = True
    declared_types: bool = False
    plans: Mapping[str, Callable[[], DataFrame]] = field(default_factory=dict, repr=False)
    _made: dict = field(default_factory=dict, repr=False)

    @classmethod
    def from_tables(cls, events: DataFrame, objects: DataFrame, e2o: DataFrame, o2o: DataFrame | None = None, declared_types: bool = False, plans: Mapping | None = None) -> Log:
        """Check the columns and put everything into the logical schema; relations get set semantics."""
        for name, df, columns in (("events", events, ("eid", "activity", "ts")), ("objects", objects, ("oid", "otype")), ("e2o", e2o, ("eid", "oid"))):
            if missing := set(columns) - set(df.columns):
                raise ValueError(f"{name} lacks {sorted(missing)}")
        has_edges = o2o is not None
        if o2o is None:
            o2o = e2o.sparkSession.createDataFrame([], "src string, dst string")
        return cls(events.select("eid", "activity", "ts"), objects.select("oid", "otype"), e2o.select("eid", "oid").distinct(), o2o.select("src", "dst").distinct(), has_edges, declared_types, plans or {})

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.plans.get(name, make)()
        return self._made[name]

    @property
    def typed(self) -> DataFrame:
        """eid, oid, otype of every relation whose object has a type."""
        return self._once("typed", lambda: relations.typed(self.e2o, self.objects))

    @property
    def participants(self) -> DataFrame:
        return self._once("participants", lambda: relations.participants(self.typed, self.events))

    @property
    def lifespan(self) -> DataFrame:
        return self._once("lifespan", lambda: relations.lifespan(self.events, self.typed))

    @property
    def cooccurrence(self) -> DataFrame:
        return self._once("cooccurrence", lambda: relations.cooccurrence(self.events, self.typed))

    @property
    def happenings(self) -> DataFrame:
        """eid, activity, ts, oid, otype, each row once: the events with their objects."""
        return self._once("happenings", lambda: self.typed.join(self.events, "eid").select("eid", "activity", "ts", "oid", "otype").distinct())

    @property
    def event_kinds(self) -> DataFrame:
        """eid, activity, times (of ts: when it happened), kinds (of otype, n): how many objects of a type take part.  One row for each event and activity."""

        def make() -> DataFrame:
            own = self.happenings.groupBy("eid", "activity").agg(F.collect_set(F.struct("ts")).alias("times"), F.collect_set(F.struct("otype", "oid")).alias("all"))
            count = lambda t: F.size(F.filter("all", lambda x: x.getField("otype") == t)).cast("long")
            return own.select("eid", "activity", "times", F.transform(F.array_distinct("all.otype"), lambda t: F.struct(t.alias("otype"), count(t).alias("n"))).alias("kinds"))

        return self._once("event_kinds", make)

    @property
    def event_classes(self) -> DataFrame:
        """activity, times, kinds, events: how many events of an activity have so many times and such counts of types."""

        def make() -> DataFrame:
            same = self.event_kinds.select("activity", F.size("times").alias("times"), F.array_sort("kinds").alias("kinds"))
            return same.groupBy("activity", "times", "kinds").agg(F.count(F.lit(1)).alias("events"))

        return self._once("event_classes", make)

    @property
    def meetings(self) -> DataFrame:
        """activity, src, stype, dst, dtype, k: how many events of an activity two objects of different types share."""
        return self._once("meetings", lambda: relations.meetings(self.events, self.typed))

    @property
    def related(self) -> DataFrame:
        """src, stype, dst, dtype: objects of different types that share an event or an explicit edge, in both directions."""

        def make() -> DataFrame:
            met = self.meetings if "meetings" in self._made else relations.pairs(self.events, self.typed)
            return relations.related(met, relations.explicit_edges(self.o2o, self.participants) if self.has_edges else None)

        return self._once("related", make)

    @property
    def degrees(self) -> DataFrame:
        """src, stype, dtype, degree: how many objects of a type each object is related to."""
        return self._once("degrees", lambda: relations.degrees(self.related))

    @property
    def degree_totals(self) -> DataFrame:
        """stype, dtype, pairs, sources: how many objects of a type are related to the other, and in how many pairs."""
        return self._once("degree_totals", lambda: relations.degree_totals(self.degrees))

    @property
    def population(self) -> DataFrame:
        """otype, population: how many objects of a type take part."""
        return self._once("population", lambda: relations.type_population(self.participants))

    @property
    def object_types(self) -> list[str]:
        return sorted(r[0] for r in (self.objects if self.declared_types else self.participants).select("otype").distinct().collect())

    def keep(self) -> Log:
        """Persist what several scorers read, but for what the source has its own plans for."""
        for name in ("typed", "participants", "lifespan", "meetings", "related", "degrees"):
            if name not in self.plans:
                getattr(self, name).persist()
        return self

    def release(self) -> None:
        for df in self._made.values():
            df.unpersist()
        self._made.clear()
