"""SQLite files as a Spark source: read only, cut into ranges of row ids, with projection in the query."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

_TYPES = {"INT": LongType(), "REAL": DoubleType(), "FLOA": DoubleType(), "DOUB": DoubleType()}


def open_read_only(path: str) -> sqlite3.Connection:
    """A connection that can't write, whatever is run on it."""
    connection = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    connection.execute("PRAGMA query_only = ON")
    return connection


@dataclass
class RowIds(InputPartition):
    low: int
    high: int


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = [f.name for f in schema.fields]
        self.path, self.table = options["path"], options["table"]
        self.pieces = int(options.get("partitions", "8"))

    def partitions(self) -> list[InputPartition]:
        with open_read_only(self.path) as c:
            low, high = c.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"').fetchone()
        width = max(1, -(-(high - low + 1) // self.pieces))
        return [RowIds(at, min(at + width - 1, high)) for at in range(low, high + 1, width)]

    def read(self, partition: RowIds | None) -> Iterator[tuple]:
        if partition is None:  # an empty table has no ranges
            return
        columns = ", ".join(f'"{n}"' for n in self.names)
        c = open_read_only(self.path)
        try:
            yield from c.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))
        finally:
            c.close()


class SqliteSource(DataSource):
    """Options: path, table, partitions.  The schema is the table's; a schema that is given selects columns."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with open_read_only(self.options["path"]) as c:
            info = c.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        if not info:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([StructField(name, _TYPES.get((kind or "").upper()[:4].strip()[:4] if kind else "", _TYPES.get((kind or "").upper()[:3], StringType()))) for _, name, kind, *_ in info])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str | None = None, partitions: int = 8):
    """A table of a SQLite file that all executors can see; ``schema`` (DDL) restricts the columns that are read."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions)
    return (reader.schema(schema) if schema else reader).load()
