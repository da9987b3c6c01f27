"""A SQLite table as a Spark data source (read), partitioned by row id ranges."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.path, self.table = options["path"], options["table"]
        self.columns = schema.names
        self.parts = int(options.get("numpartitions", 4))

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True, timeout=30)

    def partitions(self) -> list[InputPartition]:
        with self._connect() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._connect() as db:
            yield from db.execute(
                f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high)
            )


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").schema(...).option("path", ...).option("table", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: StructType, partitions: int = 4) -> DataFrame:
    """The columns of ``schema`` of a SQLite table; the file must be reachable from every executor."""
    spark.dataSource.register(SqliteSource)
    return (
        spark.read.format("sqlite").schema(schema).option("path", path).option("table", table)
        .option("numPartitions", str(partitions)).load()
    )


def write_sqlite(rows: DataFrame, path: str, table: str, batch: int = 1_000) -> None:
    """A table written for tools that read SQLite; rows stream through the driver, ``batch`` at a time."""
    names = rows.columns
    db = sqlite3.connect(path, timeout=30)
    with db:
        db.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({", ".join(chr(34) + n + chr(34) for n in names)})')
        stream = rows.toLocalIterator()
        while part := [tuple(r) for r in islice(stream, batch)]:
            db.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(names))})', part)
    db.close()
