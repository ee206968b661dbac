"""Lifespans and populations kept up to date while events arrive.

Both are decomposable (min, max and distinct), so Structured Streaming maintains them with one row of state per object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_lifespan(relations: DataFrame) -> DataFrame:
    """oid, otype, t_min, t_max from a stream of (eid, ts, oid, otype); for output modes update and complete."""
    return relations.groupBy("oid", "otype").agg(F.min("ts").alias("t_min"), F.max("ts").alias("t_max"))


def merge_lifespans(old: DataFrame, new: DataFrame) -> DataFrame:
    """What ``foreachBatch`` stores: earlier lifespans widened by those of a batch."""
    return old.unionByName(new).groupBy("oid", "otype").agg(F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"))
