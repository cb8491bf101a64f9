"""Python data sources: files of stores that Spark can't read, one task a file, and SQLite."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .formats import read_rows
from .storages import storage


class FilesSource(DataSource):
    """Rows of text cells of the files in option `files`, and how many cells each had."""

    @classmethod
    def name(cls) -> str:
        return "tidemill_files"

    def reader(self, schema) -> DataSourceReader:
        return _FilesReader(dict(self.options))


class _File(InputPartition):
    def __init__(self, path: str, values: list[str]):
        self.path, self.values = path, values


class _FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.table, self.names = json.loads(options["table"]), json.loads(options["names"])
        self.kind, self.files = options["kind"], json.loads(options["files"])

    def partitions(self) -> list[InputPartition]:
        return [_File(p, v) for p, v in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        n = len(self.names)
        for row in read_rows(storage(self.table).read(partition.path), self.kind, self.names, self.table):
            yield (*row[:n], *([None] * (n - len(row))), min(n, len(row)), *partition.values)


class SqliteSource(DataSource):
    """A table or query of a SQLite file, split by row id where it is a table."""

    @classmethod
    def name(cls) -> str:
        return "tidemill_sqlite"

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(dict(self.options))


class _Rows(InputPartition):
    def __init__(self, sql: str):
        self.sql = sql


class _SqliteReader(DataSourceReader):
    SPLIT = 250_000

    def __init__(self, options: dict[str, str]):
        self.path, self.query, self.table, self.names = options["path"], options.get("query"), options.get("table"), json.loads(options["names"])

    def partitions(self) -> list[InputPartition]:
        names = ", ".join(f'"{n}"' for n in self.names)
        if self.query:
            return [_Rows(f"SELECT {names} FROM ({self.query.rstrip().rstrip(';')})")]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            try:
                lo, hi = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            except sqlite3.OperationalError:
                return [_Rows(f'SELECT {names} FROM "{self.table}"')]
        if lo is None:
            return [_Rows(f'SELECT {names} FROM "{self.table}" LIMIT 0')]
        step = max(self.SPLIT, -(-(hi - lo + 1) // 64))
        return [_Rows(f'SELECT {names} FROM "{self.table}" WHERE rowid >= {a} AND rowid < {a + step}') for a in range(lo, hi + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            for row in c.execute(partition.sql):
                yield tuple(None if v is None else v if isinstance(v, str) else str(v) for v in row)


def register(spark) -> None:
    spark.dataSource.register(FilesSource)
    spark.dataSource.register(SqliteSource)
