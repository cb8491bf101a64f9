"""INSERT into declared tables.

Results go to a staging folder first and are then moved, so that a table can be read
and overwritten in one statement, and a failed query leaves it as it was. A table of
one named file is written by one task, as its form demands; `single_file = 'false'`
keeps Spark's part files instead, and a partitioned table is written by all tasks,
one file for each partition folder, replacing only the folders that it touches.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile

from pyspark.sql import DataFrame

from ..catalog import Table, spark_type
from .formats import write_csv, write_json, write_xlsx
from .readers import base_of, hadoop_options, is_jdbc, jdbc_options
from .storages import storage

_SQLITE = {"int": "INTEGER", "bigint": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "float": "REAL", "double": "REAL"}


def write(df: DataFrame, t: Table, overwrite: bool) -> None:
    if is_jdbc(t):
        w = df.write.format("jdbc").options(**jdbc_options(t)).option("dbtable", t.options.get("table_name") or t.name)
        (w.option("truncate", "true").mode("overwrite") if overwrite else w.mode("append")).save()
    elif t.storage == "sqlite":
        _sqlite(df, t, overwrite)
    elif t.storage in ("s3", "hdfs") or t.options.get("single_file", "").lower() == "false" and t.format != "xlsx":
        w = _writer(df, t).mode("overwrite" if overwrite else "append")
        if t.partitions:
            w = w.partitionBy(*t.partitions).option("partitionOverwriteMode", "dynamic")
        getattr(w, t.format)(base_of(t))
    elif t.storage == "local" and t.format in ("csv", "json"):
        _local(df, t, overwrite)
    else:
        _through_driver(df, t, overwrite)


def _writer(df: DataFrame, t: Table):
    w = df.write.options(**hadoop_options(t))
    if t.format == "csv":
        w = w.options(sep=(t.options.get("delimiter") or ",").encode().decode("unicode_escape"), header=_header(t), emptyValue="", nullValue="", escape='"')
    return w


def _header(t: Table) -> bool:
    return t.options.get("include_header", "").lower() == "true"


def file_name(t: Table) -> str:
    return t.options.get("file_name") or f"result.{t.format}"


def _parts(folder: str) -> list[str]:
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.startswith("part-"))


def _place(part: str, target: str, append: bool, header: bool) -> None:
    """Move a written file to its name, or add its lines to what is there."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    if append and os.path.exists(target) and os.path.getsize(target):
        with open(f"{target}.tmp", "wb") as out:
            with open(target, "rb") as old:
                shutil.copyfileobj(old, out, 1 << 20)
            out.seek(-1, os.SEEK_END)
            with open(f"{target}.tmp", "rb") as back:
                back.seek(-1, os.SEEK_END)
                ends = back.read(1) == b"\n" if out.flush() is None else True
            out.seek(0, os.SEEK_END)
            if not ends:
                out.write(b"\n")
            with open(part, "rb") as new:
                if header:
                    new.readline()
                shutil.copyfileobj(new, out, 1 << 20)
    else:
        shutil.move(part, f"{target}.tmp")
    os.replace(f"{target}.tmp", target)


def _local(df: DataFrame, t: Table, overwrite: bool) -> None:
    base = os.path.abspath(base_of(t))
    os.makedirs(base, exist_ok=True)
    stage = tempfile.mkdtemp(prefix=".stage-", dir=base)
    try:
        out = os.path.join(stage, "out")
        if t.partitions:
            # one task, and so one file, for each partition folder
            w = _writer(df.repartition(*t.partitions), t).partitionBy(*t.partitions)
        else:
            w = _writer(df.coalesce(1), t)
        getattr(w, t.format)(out)
        parts = _parts(out)
        if not t.partitions and not parts:
            parts = [os.path.join(stage, "none")]
            open(parts[0], "wb").close()
        for p in parts:
            folder = os.path.relpath(os.path.dirname(p), out)
            if t.partitions and t.options.get("partition_format", "").lower() == "value":
                folder = "/".join(f.split("=", 1)[1] for f in folder.split("/"))
            _place(p, os.path.normpath(os.path.join(base, folder, file_name(t))), not overwrite, _header(t) and t.format == "csv")
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def _through_driver(df: DataFrame, t: Table, overwrite: bool) -> None:
    """Workbooks and stores without a Hadoop connector: rows stream through the driver into one file a partition."""
    s = storage(t.options)
    s.base = base_of(t) if t.storage in ("local", "gitlfs") else s.base
    names = [c.name for c in t.data_columns]
    groups = [((), df)] if not t.partitions else [(tuple(r), None) for r in df.select(*t.partitions).distinct().toLocalIterator()]
    for values, part in groups:
        if part is None:
            part = df
            for p, v in zip(t.partitions, values):
                part = part.where(part[p].eqNullSafe(v))
        folders = [v or "" if t.options.get("partition_format", "").lower() == "value" else f"{p}={v or ''}" for p, v in zip(t.partitions, values)]
        path = s.join(s.base, *folders, file_name(t))

        def cells():
            if not overwrite:
                from .formats import read_rows

                try:
                    old = s.read(path)
                except (OSError, FileNotFoundError):
                    old = b""
                if old:
                    yield from ([x or "" for x in r] for r in read_rows(old, t.format, names, {k: v for k, v in t.options.items() if k != "skip_lines"} | {"skip_lines": str(int(_header(t) and t.format == "csv"))}))
            for row in part.select(*(part[n].cast("string") for n in names)).toLocalIterator():
                yield ["" if v is None else v for v in row]

        def rows():
            if _header(t) and t.format != "json":
                yield names
            yield from cells()

        data = write_xlsx(rows(), t.options.get("sheet") or "Sheet1") if t.format == "xlsx" else write_json(cells(), names) if t.format == "json" else write_csv(rows(), t.options)
        s.write(path, data)


def _sqlite(df: DataFrame, t: Table, overwrite: bool) -> None:
    """One connection writes, as the file allows only one; rows stream to it in batches within one transaction."""
    name, names = t.options.get("table_name") or t.name, [c.name for c in t.columns]
    rows = df.select(*(df[n] if spark_type(c.type) in _SQLITE else df[n].cast("string") for n, c in zip(names, t.columns)))
    c = sqlite3.connect(t.options.get("path", ""))
    try:
        c.execute(f'CREATE TABLE IF NOT EXISTS "{name}" ({", ".join(f"{chr(34)}{x.name}{chr(34)} {_SQLITE.get(spark_type(x.type), "TEXT")}" for x in t.columns)})')
        c.commit()
        # read before the table is emptied: the query may be over it
        staged = f"__{name}_stage"
        c.execute(f'CREATE TEMP TABLE "{staged}" ({", ".join(chr(34) + n + chr(34) for n in names)})')
        mark = ", ".join("?" * len(names))
        batch: list[tuple] = []
        for r in rows.toLocalIterator():
            batch.append(tuple(r))
            if len(batch) >= 10_000:
                c.executemany(f'INSERT INTO "{staged}" VALUES ({mark})', batch)
                batch = []
        c.executemany(f'INSERT INTO "{staged}" VALUES ({mark})', batch)
        if overwrite:
            c.execute(f'DELETE FROM "{name}"')
        c.execute(f'INSERT INTO "{name}" ({", ".join(chr(34) + n + chr(34) for n in names)}) SELECT * FROM "{staged}"')
        c.commit()
    finally:
        c.close()
