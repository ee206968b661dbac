"""Scores between object types: temporal order, cardinality, divergence, and their weighted mean.

Every scorer counts with integers and divides once, in a fixed order, so results do not depend on how the data is partitioned.
All results have one row per ordered pair of participating types.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import TYPE_CHECKING, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relations import settled

if TYPE_CHECKING:
    from ..log import Log

PAIR = ["source_type", "target_type"]


class Scorer(Protocol):
    """A weight, and push and pull for each ordered pair of types."""

    weight: float

    def scores(self, log: Log) -> DataFrame:
        """source_type, target_type, push, pull."""


def type_pairs(log: Log) -> DataFrame:
    """All ordered pairs of types with their populations of participants (types squared: a handful of rows); types without any only on demand."""
    population = log.population
    if log.declared_types:
        population = log.objects.select("otype").distinct().join(F.broadcast(population), "otype", "left").fillna(0, ["population"])
    one = population.select(F.col("otype").alias("source_type"), F.col("population").alias("n"))
    two = population.select(F.col("otype").alias("target_type"), F.col("population").alias("n_rev"))
    return one.crossJoin(two)


def _zero_diagonal(value: Column) -> Column:
    return F.when(F.col("source_type") == F.col("target_type"), F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))


class CountingScorer:
    """A scorer whose push and pull are arithmetic over counts per ordered pair of types.

    In ``push`` and ``pull`` a count ``c`` is the pair's own, ``c_rev`` that of the pair the other way round; n and n_rev are the populations.
    """

    columns: tuple[str, ...] = ()

    def __init__(self, weight: float = 1):
        self.weight = weight

    def counts(self, log: Log) -> list[DataFrame]:
        """Frames of PAIR and some of the columns; pairs that are missing count 0."""
        raise NotImplementedError

    def push(self) -> Column:
        raise NotImplementedError

    def pull(self) -> Column:
        raise NotImplementedError

    def scores(self, log: Log) -> DataFrame:
        return wide_counts(log, [self]).select(*PAIR, _zero_diagonal(self.push()).alias("push"), _zero_diagonal(self.pull()).alias("pull"))


def wide_counts(log: Log, scorers: Sequence[CountingScorer], settle: bool = False) -> DataFrame:
    """All pairs of types with every count in both directions: one aggregation over the union of all counters, each row entered both ways round.

    With ``settle`` one count is made after the other, so that the disks hold the shuffles of one.
    """
    names = [c for s in scorers for c in s.columns]
    frames = []
    for frame in (f for s in scorers for f in s.counts(log)):
        own = [c for c in names if c in frame.columns]
        frame = settled(frame) if settle else frame
        frames.append(frame.select(*PAIR, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in own])).alias("m")).select(*PAIR, "m.*"))
    both = reduce(DataFrame.unionByName, frames)
    turned = F.explode(F.array(F.struct(*PAIR, "name"), F.struct(F.col("target_type").alias("source_type"), F.col("source_type").alias("target_type"), F.concat("name", F.lit("_rev")).alias("name"))))
    both = both.select(turned.alias("x"), "value").select("x.*", "value")
    every = [*names, *(f"{c}_rev" for c in names)]
    wide = both.groupBy(*PAIR).agg(*[F.sum(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in every])
    # as many rows as the square of the number of types, which the solver holds on the driver anyway
    pairs = settled(type_pairs(log)) if settle else type_pairs(log)
    return pairs.join(F.broadcast(wide), PAIR, "left").fillna(0, every)


# temporal order


def time_counters(log: Log) -> DataFrame:
    """Related pairs with both lifespans known, and how many of them have the source within the target (D) or initiating it (I)."""
    if "time_counters" in log.plans:
        return log.plans["time_counters"]()
    life = log.lifespan
    source = life.select(F.col("oid").alias("src"), F.col("t_min").alias("s0"), F.col("t_max").alias("s1"))
    target = life.select(F.col("oid").alias("dst"), F.col("t_min").alias("t0"), F.col("t_max").alias("t1"))
    rows = log.related.join(source, "src").join(target, "dst")
    within = (F.col("t0") <= F.col("s0")) & (F.col("s1") <= F.col("t1"))
    initiates = (F.col("s1") <= F.col("t0")) | ((F.col("s0") < F.col("t0")) & (F.col("t0") <= F.col("s1")) & (F.col("s1") < F.col("t1")))
    counts = rows.groupBy(F.col("stype").alias("source_type"), F.col("dtype").alias("target_type"))
    return counts.agg(F.count(F.lit(1)).alias("total"), F.count_if(within).alias("dependent"), F.count_if(initiates).alias("initiating"))


class TimeScorer(CountingScorer):
    columns = ("total", "dependent", "initiating")

    def counts(self, log: Log) -> list[DataFrame]:
        return [time_counters(log)]

    def push(self) -> Column:
        return F.try_divide(F.col("dependent_rev") - F.col("dependent"), F.col("total"))

    def pull(self) -> Column:
        return F.try_divide(F.col("initiating_rev") + F.col("initiating"), F.col("total"))


# cardinality


def bilateral_signatures(log: Log) -> DataFrame:
    """Per object and partner type the partners' reverse degrees, as sorted 'degree x count' runs: the same multiset as a sorted list, and short for hubs."""
    if "bilateral_signatures" in log.plans:
        return log.plans["bilateral_signatures"]()
    back = log.degrees.select(F.col("src").alias("dst"), F.col("stype").alias("dtype"), F.col("dtype").alias("stype"), F.col("degree").alias("reverse"))
    runs = log.related.join(back, ["dst", "dtype", "stype"]).groupBy("src", "stype", "dtype", "reverse").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("reverse", "n")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat_ws("x", x.getField("reverse"), x.getField("n"))), ",")
    return runs.groupBy("src", "stype", "dtype").agg(F.sum("n").alias("degree"), text.alias("signature"))


def _constant(log: Log) -> DataFrame:
    """How many sources share the most frequent signature of each pair of types."""
    if "constant" in log.plans:
        return log.plans["constant"]()
    by_signature = bilateral_signatures(log).groupBy(F.col("stype").alias("source_type"), F.col("dtype").alias("target_type"), "signature").agg(F.count(F.lit(1)).alias("sources"))
    return by_signature.groupBy(*PAIR).agg(F.max("sources").alias("constant"))


def dominant_signature(log: Log) -> DataFrame:
    """Of each pair of types: sources in all, sources that share the most frequent signature, and the others."""
    rows = type_pairs(log).where("source_type <> target_type").join(F.broadcast(_constant(log)), PAIR, "left").fillna(0, ["constant"])
    return rows.select(*PAIR, F.col("n").alias("total"), "constant", (F.col("n") - F.col("constant")).alias("other"))


class CardinalityScorer(CountingScorer):
    columns = ("constant",)

    def counts(self, log: Log) -> list[DataFrame]:
        return [_constant(log)]

    def push(self) -> Column:
        return F.try_divide(F.col("n") - F.col("constant"), F.col("n")) - F.try_divide(F.col("n_rev") - F.col("constant_rev"), F.col("n_rev"))

    def pull(self) -> Column:
        return F.try_divide(F.col("constant") + F.col("constant_rev"), F.col("n") + F.col("n_rev"))


# divergence


def diverging_targets(log: Log) -> DataFrame:
    """src, stype, dst, dtype, activity where events of the activity that show src partners of dst's type do not all show dst.

    An object diverges exactly when it is in some but not all of the partner sets, that is in fewer events (k) than there are with any partner (n); no set is built.
    """
    if "diverging_targets" in log.plans:
        return log.plans["diverging_targets"]()
    kinds = log.typed.select("eid", F.col("otype").alias("dtype")).distinct()
    own = log.typed.join(log.events.select("eid", "activity"), "eid").select("eid", "activity", F.col("oid").alias("src"), F.col("otype").alias("stype"))
    seen = own.join(kinds, "eid").where("stype <> dtype").groupBy("activity", "src", "dtype").agg(F.count(F.lit(1)).alias("n"))
    # whoever has a single event cannot diverge; without them this side is often small enough for AQE to broadcast
    seen = seen.where("n > 1").select(F.col("activity").alias("_a"), F.col("src").alias("_s"), F.col("dtype").alias("_d"), "n")
    rows = log.meetings.join(seen, F.expr("activity <=> _a and src = _s and dtype = _d"))
    return rows.where("k < n").select("activity", "src", "stype", "dst", "dtype", "k", "n")


def divergence_counts(log: Log) -> DataFrame:
    if "divergence_counts" in log.plans:
        return log.plans["divergence_counts"]()
    rows = diverging_targets(log).groupBy(F.col("stype").alias("source_type"), F.col("dtype").alias("target_type"))
    return rows.agg(F.countDistinct("dst").alias("diverging"))


def divergence_ratio(log: Log) -> DataFrame:
    rows = type_pairs(log).where("source_type <> target_type").join(F.broadcast(divergence_counts(log)), PAIR, "left").fillna(0, ["diverging"])
    return rows.select(*PAIR, "diverging", F.col("n_rev").alias("population"), F.try_divide("diverging", "n_rev").alias("ratio"))


def interaction_counts(log: Log) -> DataFrame:
    """How many sources have a partner of the target type at all."""
    return log.degree_totals.select(F.col("stype").alias("source_type"), F.col("dtype").alias("target_type"), F.col("sources").alias("interacting"))


class DivergenceScorer(CountingScorer):
    columns = ("interacting", "diverging")

    def counts(self, log: Log) -> list[DataFrame]:
        return [interaction_counts(log), divergence_counts(log)]

    def push(self) -> Column:
        return F.try_divide("diverging", "n_rev") - F.try_divide("diverging_rev", "n")

    def pull(self) -> Column:
        r, r_rev = F.try_divide("diverging", "n_rev"), F.try_divide("diverging_rev", "n")
        return (1 - r) * (1 - r_rev) * F.greatest(F.try_divide("interacting", "n"), F.try_divide("interacting_rev", "n_rev"))


def default_scorers() -> list[Scorer]:
    return [TimeScorer(), CardinalityScorer(), DivergenceScorer()]


def score_matrix(log: Log, scorers: Sequence[Scorer] | None = None, settle: bool = False) -> DataFrame:
    """Weighted mean of the scorers, by column arithmetic in the scorers' order."""
    scorers = default_scorers() if scorers is None else list(scorers)
    if not scorers or not sum(s.weight for s in scorers):
        raise ValueError("scorers need a weight")
    counting = [s for s in scorers if isinstance(s, CountingScorer)]
    rows = wide_counts(log, counting, settle) if counting else type_pairs(log)
    for k, scorer in enumerate(scorers):
        if scorer in counting:
            rows = rows.withColumns({f"push{k}": scorer.push(), f"pull{k}": scorer.pull()})
        else:
            own = scorer.scores(log).select(*PAIR, F.col("push").alias(f"push{k}"), F.col("pull").alias(f"pull{k}"))
            rows = rows.join(F.broadcast(own), PAIR, "left")
    total = float(sum(s.weight for s in scorers))

    def mean(kind: str) -> Column:
        terms = [F.coalesce(F.col(f"{kind}{k}"), F.lit(0.0)) * float(s.weight) for k, s in enumerate(scorers)]
        return _zero_diagonal(reduce(lambda a, b: a + b, terms) / total)

    return rows.select(*PAIR, mean("push").alias("push"), mean("pull").alias("pull"))


def score_matrix_pivot(matrix: DataFrame, value: str = "push", decimals: int = 4, types: list[str] | None = None) -> DataFrame:
    """The matrix as a rounded table, one column per target type."""
    pivot = matrix.groupBy("source_type").pivot("target_type", types)
    return pivot.agg(F.round(F.first(value), decimals))
