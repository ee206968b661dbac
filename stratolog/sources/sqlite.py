"""A Spark data source for tables of SQLite files, on the standard library's driver.

The file has to be readable where tasks run.  Rows are split by ranges of rowid.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _name(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


class Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class TableReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, table: str, parts: int):
        self.columns, self.path, self.table, self.parts = schema.names, path, table, parts

    def partitions(self) -> list[Rows]:
        with _open(self.path) as db:
            lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        if lo is None:
            return [Rows(0, 0)]
        step = -(-(hi - lo + 1) // self.parts)
        return [Rows(at, min(at + step, hi + 1)) for at in range(lo, hi + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        columns = ", ".join(f"CAST({_name(c)} AS TEXT)" for c in self.columns)
        with _open(self.path) as db:
            yield from db.execute(f"SELECT {columns} FROM {_name(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.lo, partition.hi))


class SQLiteTable(DataSource):
    """Options: path, table, parts (8).  Every column is read as text."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with _open(self.options["path"]) as db:
            columns = [r[1] for r in db.execute(f"PRAGMA table_info({_name(self.options['table'])})")]
        return ", ".join(f"`{c}` string" for c in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return TableReader(schema, self.options["path"], self.options["table"], int(self.options.get("parts", 8)))


def tables(path: str) -> list[str]:
    with _open(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
