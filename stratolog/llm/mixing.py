"""Mixing sources to target weights by Pareto order sampling.

Targets: sources share ``total`` of all words by weight; a source stops at ``most`` times its own words and the excess goes to the others by weight.
That is water filling with one level, found in closed form over one row per source: source i is capped exactly when the volume at its own level
r_i = cap_i / w_i is within the total.  Sources may be as many as hosts: their order and the running sums over it are found by ranges, each range in its
own task, and only the sums of whole ranges meet.

Within a source a document's expected copies grow with the logarithm of its size, again water-filled (over size classes) so that the expected words
equal the target and nobody exceeds ``most`` copies.  The whole part of the expected copies is allocated with certainty.  The rest, pi, is sampled
by Pareto order sampling: rank by (U / (1 - U)) / (pi / (1 - pi)) and take from the smallest on until the words still missing are reached.  U is a
hash of id, content and occurrence number, so reruns agree and rows that repeat are drawn one by one.

The cut in that order is found without sorting a source in one task: two levels of histograms (``BINS`` bins each, a fixed number of rows per source)
narrow it to one fine bin, and only that bin's documents are put in order.  What the documents are then compared with is one row per source.

Null texts, empty texts and texts without a word have size 0, a class of their own, and no copies.  Null sources are one source, last.  Null ids take part like any other.
Rows that are equal in every column (maps aside) are numbered among themselves; how many of them are taken is the same in every run.
An empty table gives an empty result.  Extra columns pass through ``expand``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, few, hashable, hashes, reliable, whole_row

BINS = 4096


def sizes(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id, source, size (words), h1 and h2 (a hash of the row) and pid (the task that read it) of every document, and the columns ``more``."""
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = hashes(*hashable(docs))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n.alias("size"), *own, F.spark_partition_id().alias("pid"), *more)


def _running(rows: DataFrame, by: Column, **sums: str | Column) -> DataFrame:
    """rows with running sums in the order ``by`` (equal values together), over all rows and without one task that sees them all.

    Rows are dealt by ranges of ``by``; each range adds up its own rows, and the ranges (as many as shuffle partitions) add up among themselves.
    """
    dealt = reliable(rows.withColumns({"_by": by, **sums}).repartitionByRange("_by").withColumn("_range", F.spark_partition_id()))
    whole = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = whole.select("_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    upto = W.partitionBy("_range").orderBy("_by").rangeBetween(W.unboundedPreceding, W.currentRow)
    found = dealt.join(F.broadcast(reliable(offsets)), "_range")  # one row for each shuffle partition
    return found.withColumns({c: F.sum(c).over(upto) + F.col(f"_{c}") for c in sums}).drop("_range", "_by", *[f"_{c}" for c in sums])


def _level(rows: DataFrame, by: list[str], total: str, out: str) -> DataFrame:
    """Water level of each group: rows have weight ``w``, cap ``cap`` and the group's total; the level is total / weights left after caps."""
    r = F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(0.0))
    upto = W.partitionBy(*by).orderBy("_r").rangeBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy(*by)
    rows = rows.withColumn("_r", r)
    rows = rows.withColumn("_c", F.sum("cap").over(upto)).withColumn("_w", F.sum("w").over(every) - F.sum("w").over(upto))
    rows = rows.withColumn("_capped", F.col("_c") + F.col("_r") * F.col("_w") <= F.col(total))
    caps = F.sum(F.when(F.col("_capped"), F.col("cap")).otherwise(0.0)).over(every)
    free = F.sum(F.when(F.col("_capped"), F.lit(0.0)).otherwise(F.col("w"))).over(every)
    rows = rows.withColumn("_level", F.try_divide(F.col(total) - caps, free))
    return rows.withColumn(out, F.when(F.col("_capped"), F.col("cap")).otherwise(F.col("w") * F.col("_level"))).drop("_r", "_c", "_w", "_capped", "_level")


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: its words and its target.  Sources in code-point order (null last) get the weights in turn."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _running(by_source, F.struct(F.isnull("source"), "source"), rank=F.lit(1))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    rows = ranked.withColumn("w", turn).withColumn("cap", F.when(F.col("w") > 0, F.col("source_size") * F.lit(float(most))).otherwise(0.0))
    rows = _running(rows, F.try_divide("cap", "w"), caps=F.col("cap"), ws=F.col("w"))
    weight, words = rows.agg(F.sum("w"), F.sum("source_size")).first()
    goal = float(total) * (words or 0)
    rows = reliable(rows.withColumn("_capped", (F.col("w") <= 0) | (F.col("caps") + F.try_divide("cap", "w") * (F.lit(weight or 0.0) - F.col("ws")) <= F.lit(goal))))
    full, free = rows.agg(F.sum(F.when(F.col("_capped"), F.col("cap"))), F.sum(F.when(~F.col("_capped"), F.col("w")))).first()
    level = (goal - (full or 0.0)) / free if free else 0.0
    return rows.select("source", "source_size", F.when(F.col("_capped"), F.col("cap")).otherwise(F.col("w") * F.lit(level)).alias("target"))


def _numbered(sized: DataFrame) -> DataFrame:
    """sized with ``no``: 0, 1, 2 ... among equal rows.

    A task's rows are numbered by themselves and shifted by the number of equal rows in the tasks before it, so that no task sees all rows of a large group.
    """
    own = W.partitionBy("h1", "h2", "pid").orderBy("size").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = sized.withColumn("_no", F.sum(F.lit(1)).over(own) - 1)
    per = sized.groupBy("h1", "h2", "pid").agg(F.count(F.lit(1)).alias("n"))
    repeated = per.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("tasks")).where("tasks > 1").drop("tasks")
    before = W.partitionBy("h1", "h2").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    shift = per.join(repeated, ["h1", "h2"], "left_semi").withColumn("_shift", F.sum("n").over(before)).where("_shift is not null").drop("n")
    shift = few(reliable(shift))
    return local.join(shift, ["h1", "h2", "pid"], "left").withColumn("no", F.col("_no") + F.coalesce("_shift", F.lit(0))).drop("_no", "_shift", "pid")


def _class() -> Column:
    """0 for no words, else the number of binary digits of the size."""
    return F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)


def _drawn(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows with the plan of their source and class of size, and ``rank``: (Pareto rank mapped from (0, inf) to (0, 1) in order, a hash, the row's key); null if not drawn."""
    rows = rows.withColumn("_class", _class()).join(few(plan), F.expr("source <=> _s and _class = _c"), "left").drop("_s", "_c", "_class")
    draw = F.xxhash64(F.lit(seed), "h1", "h2", "no")
    rows = rows.withColumn("_u", (F.shiftrightunsigned(draw, 11).cast("double") + 0.5) / F.lit(float(2**53)))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("pi") / (1 - F.col("pi")))
    rank = F.struct((odds / (1 + odds)).alias("q"), draw.alias("u"), "h1", "h2", "no")
    return rows.withColumn("rank", F.when((F.col("pi") > 0) & (F.col("missing") > 0), rank)).drop("_u")


def _plan(sized: DataFrame, weights: tuple[float, ...], total: float, most: float) -> DataFrame:
    """One row per source (_s) and class of size (_c): target, whole copies, the fraction pi to draw, and the words missing in the source."""
    goal = targets(sized, weights, total, most)
    by_class = (
        sized.groupBy("source", _class().alias("class"))
        .agg(F.sum("size").cast("double").alias("words"))
        .join(goal.withColumnRenamed("source", "_s"), F.expr("source <=> _s"))
        .drop("_s")
        .withColumn("w", F.col("class") * F.col("words"))
        .withColumn("cap", F.col("words") * F.lit(float(most)))
    )
    # expected copies of each class: its share of the target over its words; a rounding error near a whole number is no fraction
    by_class = _level(by_class, ["source"], "target", "share")
    copies = F.least(F.lit(float(most)), F.coalesce(F.try_divide("share", "words"), F.lit(0.0)))
    whole = F.floor(F.col("expected") + 1e-9)
    by_class = by_class.withColumn("expected", copies).withColumn("whole", whole).withColumn("pi", F.greatest(F.lit(0.0), F.col("expected") - whole))
    missing = F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("whole") * F.col("words")).over(W.partitionBy("source")))
    by_class = by_class.withColumn("missing", missing)
    pi = F.when(F.col("pi") > 1e-9, F.col("pi"))
    return reliable(by_class.select(F.col("source").alias("_s"), F.col("class").alias("_c"), "source_size", "target", "whole", pi.alias("pi"), "missing"))


def _cuts(drawn: DataFrame) -> DataFrame:
    """Of each source (_s) the last rank taken: taking it brings the words nearer to those missing."""
    binned = drawn.where("rank is not null").withColumn("bin", F.floor(F.col("rank.q") * BINS)).withColumn("fine", F.floor(F.col("rank.q") * BINS * BINS) % BINS)
    binned = reliable(binned.select("source", "size", "rank", "bin", "fine", "missing"))
    coarse = _crossing(binned.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("missing").alias("missing")), "bin")
    coarse = few(reliable(coarse.select(F.col("source").alias("_s"), F.col("bin").alias("_b"), "missing_left")))
    inside = binned.drop("missing").join(coarse, F.expr("source <=> _s and bin = _b")).drop("_s", "_b")
    finer = _crossing(inside.groupBy("source", "fine").agg(F.sum("size").alias("words"), F.first("missing_left").alias("missing")), "fine")
    finer = few(reliable(finer.select(F.col("source").alias("_s"), F.col("fine").alias("_f"), F.col("missing_left").alias("_left"))))
    # only the documents of one fine bin per source are put in order
    last = inside.join(finer, F.expr("source <=> _s and fine = _f")).drop("_s", "_f")
    order = W.partitionBy("source").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = last.withColumn("_sum", F.sum("size").over(order))
    cut = F.max(F.when(F.col("_sum") - F.col("size") / 2 <= F.col("_left"), F.col("rank")))
    # if not even the bin's first document is taken, all before the bin are
    first = F.min("rank")
    rows = last.groupBy("source").agg(cut.alias("_cut"), first.alias("_next"))
    return reliable(rows.withColumnRenamed("source", "_s"))


def _copies(drawn: DataFrame, cuts: DataFrame) -> DataFrame:
    """drawn with ``copies``."""
    rows = drawn.join(few(cuts), F.expr("source <=> _s"), "left").drop("_s")
    taken = F.coalesce((F.col("rank") <= F.col("_cut")) | (F.col("_cut").isNull() & (F.col("rank") < F.col("_next"))), F.lit(False))
    rows = rows.withColumn("copies", F.coalesce(F.col("whole"), F.lit(0)).cast("long") + taken.cast("long"))
    return rows.drop("whole", "pi", "missing", "rank", "_cut", "_next")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document."""
    sized = reliable(sizes(docs))
    drawn = reliable(_drawn(_numbered(sized), _plan(sized, weights, total, most), seed))
    rows = _copies(drawn, _cuts(drawn))
    return rows.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def expand(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The columns of ``docs``, each document as often as the mix takes it.

    Rows equal in all columns (maps aside) cannot be told apart: one of them stands for the copies of all of them.  No other row moves; its copies follow from its hash.
    """
    sized = reliable(sizes(docs))
    plan = _plan(sized, weights, total, most)
    drawn = reliable(_drawn(_numbered(sized), plan, seed))
    cuts = _cuts(drawn)
    again = _copies(drawn, cuts).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies")).where("n > 1").drop("n")
    again = few(reliable(again))
    rows = sizes(docs, whole_row(docs))
    single = rows.join(again, ["h1", "h2"], "left_anti").withColumn("no", F.lit(0).cast("long"))
    single = _copies(_drawn(single, plan, seed), cuts).select("row", "copies")
    equal = rows.join(again, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("row").alias("row")).join(again, ["h1", "h2"]).select("row", "copies")
    every = single.unionByName(equal).where("copies > 0")
    return every.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("r")).select("r.*")


def _crossing(bins: DataFrame, key: str) -> DataFrame:
    """Of each source the first bin at which the words reach those missing (the last bin if rounding leaves them short), with what is missing before it."""
    order = W.partitionBy("source").orderBy(key)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = bins.withColumn("_upto", F.sum("words").over(upto)).withColumn("_last", F.lead("words").over(order).isNull())
    rows = rows.where((F.col("_upto") - F.col("words") < F.col("missing")) & ((F.col("_upto") >= F.col("missing")) | F.col("_last")))
    return rows.withColumn("missing_left", F.col("missing") - (F.col("_upto") - F.col("words")))
