"""Shared pieces: reliable checkpoints and zero-copy views of Arrow text columns."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a longest run of characters other than these blanks.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share; only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="stratolog-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def reliable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder all executors share and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(True)


#: Rows of small columns up to which a table is broadcast; beyond that the same join runs by shuffle.
BROADCAST = 100_000


def few(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if a count of its rows allows that."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hashes(*cols: str | Column) -> tuple[Column, Column]:
    """128 bits that tell different values apart, as two longs (``h1``, ``h2``); a null differs from every value."""
    parts = [p for c in cols for p in (F.isnull(c), c)]
    return F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("h2"), *parts).alias("h2")


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def hashable(docs: DataFrame) -> list[str]:
    """The columns of ``docs`` that a hash can be made of: all but those with a map inside."""
    return [quoted(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]


def whole_row(docs: DataFrame, name: str = "row") -> Column:
    """Every column of ``docs`` in one struct, out of the way of an operator's own columns."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias(name)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and where each row starts (n + 1 offsets); a null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most_bytes: int = 4 << 20, most_rows: int = 256):
    """Cut rows into consecutive blocks of about ``most_bytes`` (a longer row is its own block)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), at + most_rows, n)
        yield at, to
        at = to
