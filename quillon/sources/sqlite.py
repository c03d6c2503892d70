"""SQLite as a Spark source: one table a read, in ranges of row ids.

    spark.dataSource.register(SQLiteSource)
    spark.read.format("sqlite").option("path", ...).option("table", ...).load()

The file must be one that executors reach (as with any file source).
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

#: Tables that a documentation database must have.
REQUIRED_TABLES = {"name_info", "declaration_ranges", "modules"}
_KINDS = (("INT", LongType()), ("CHAR", StringType()), ("TEXT", StringType()), ("CLOB", StringType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType()))


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def is_usable(path: str, required: set[str] = REQUIRED_TABLES) -> bool:
    """The file isn't empty, is SQLite, and has the tables."""
    if not os.path.isfile(path) or not os.path.getsize(path):
        return False
    try:
        with _connect(path) as c:
            there = {name for (name,) in c.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
    except sqlite3.Error:
        return False
    return required <= there


class Rows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SQLiteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.table, self.n = options["path"], options["table"], int(options.get("partitions", 8))
        self.names = [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        with _connect(self.path) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [Rows(0, 0)]
        step = max(1, -(-(high - low + 1) // self.n))
        return [Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        columns = ", ".join(map(_quoted, self.names))
        with _connect(self.path) as c:
            yield from c.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))


class SQLiteSource(DataSource):
    """Options: path, table, partitions (8)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with _connect(self.options["path"]) as c:
            columns = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return StructType([StructField(name, next((k for mark, k in _KINDS if mark in kind.upper()), BinaryType())) for _, name, kind, *_ in columns])

    def reader(self, schema: StructType) -> SQLiteReader:
        return SQLiteReader(self.options, schema)


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).load()
