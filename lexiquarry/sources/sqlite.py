"""The source table of an SQLite file, (id, json), as a Spark data source: spark.read.format("catalogue_sqlite").

Options: path (a file that all executors see), table (default "comics"), parts (ranges of id, default 8).
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "catalogue_sqlite"


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.parts = options["path"], options.get("table", "comics"), int(options.get("parts", 8))
        if not self.table.isidentifier():
            raise ValueError(f"{self.table!r} is no table name")

    def partitions(self) -> list[Range]:
        with closing(_open(self.path)) as c:
            low, high = c.execute(f"SELECT min(id), max(id) FROM {self.table}").fetchone()
        if low is None:
            return [Range(0, 0)]
        step = max(1, -(-(high + 1 - low) // self.parts))
        return [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple[int, str]]:
        with closing(_open(self.path)) as c:
            yield from c.execute(f"SELECT id, json FROM {self.table} WHERE id >= ? AND id < ? ORDER BY id", (partition.low, partition.high))


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "id long, json string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read(spark: SparkSession, path: str, table: str = "comics", parts: int = 8) -> DataFrame:
    """(id, json) of the table; raises sqlite3.OperationalError where there is no such file."""
    with closing(_open(path)) as c:
        c.execute(f"SELECT id FROM {table} LIMIT 1" if table.isidentifier() else "SELECT 1")
    spark.dataSource.register(SQLiteSource)
    return spark.read.format(FORMAT).option("path", path).option("table", table).option("parts", parts).load()
