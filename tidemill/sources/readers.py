"""Declared tables as DataFrames.

Cells are read as text and cast by the declared type, so that a bad cell becomes
NULL; the empty cell is NULL. DEFAULT stands in for cells that a short line lacks.
CSV and JSON on file systems Spark knows use its own readers, with column pruning,
splitting of large files and partition pruning.
"""

from __future__ import annotations

import glob
import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import PORTS, Table, spark_type
from ..plans.rewrite import default_literal
from . import datasources
from .storages import GitLfs, storage

_EXT = {"csv": "csv", "json": "json", "xlsx": "xlsx"}
_JDBC = {"mysql": "jdbc:mysql", "postgres": "jdbc:postgresql"}


def register_database(name: str, jdbc_prefix: str, port: str) -> None:
    """Add a database that Spark reaches over JDBC; its driver must be on the class path."""
    _JDBC[name.lower()] = jdbc_prefix
    PORTS[name.lower()] = port


class NoFiles(FileNotFoundError):
    """A table without a file to read."""


def pattern_of(t: Table) -> str:
    return t.options.get("file_pattern") or t.options.get("file_name") or f"*.{_EXT.get(t.format, t.format)}"


def base_of(t: Table) -> str:
    """The folder as Spark takes it."""
    path = t.options.get("path", "") or "."
    if t.storage == "s3":
        return f"s3a://{t.options.get('bucket', '')}/{path.strip('/')}"
    return path.removeprefix("local://")


def hadoop_options(t: Table) -> dict[str, str]:
    """What an S3 table's options say, as Hadoop takes it; Spark hands reader and writer options on."""
    if t.storage != "s3":
        return {}
    o = t.options
    named = {"endpoint": "endpoint", "region": "endpoint.region", "access_key": "access.key", "access_secret": "secret.key", "use_path_style": "path.style.access"}
    return {f"fs.s3a.{k2}": o[k] for k, k2 in named.items() if o.get(k)}


def is_bare(t: Table) -> bool:
    """Whether partition folders carry values only."""
    if t.options.get("partition_format", "").lower() == "value":
        return True
    base = base_of(t)
    if t.storage != "local" or not os.path.isdir(base):
        return False
    folders = [e.name for e in os.scandir(base) if e.is_dir() and not e.name.startswith((".", "_"))]
    return bool(folders) and not any(f.lower().startswith(f"{t.partitions[0].lower()}=") for f in folders)


def load(spark: SparkSession, t: Table) -> DataFrame:
    if t.storage in _JDBC:
        return _typed(t, _jdbc(spark, t))
    if t.storage == "sqlite":
        datasources.register(spark)
        names = [c.name for c in t.columns]
        r = spark.read.format("tidemill_sqlite").schema(", ".join(f"`{n}` string" for n in names)).option("path", t.options.get("path", "")).option("names", json.dumps(names))
        r = r.option("query", t.options["query"]) if t.options.get("query") else r.option("table", t.options.get("table_name") or t.name)
        return _typed(t, r.load())
    if t.storage in ("local", "s3", "hdfs", "gitlfs") and t.format in ("csv", "json") and not (t.format == "csv" and int(t.options.get("skip_lines", 0) or 0) > 1):
        return _native(spark, t)
    return _by_file(spark, t)


def _typed(t: Table, df: DataFrame, present: Column | None = None) -> DataFrame:
    """Declared types from text cells; present: how many cells the line had."""
    out = []
    parts = {p.lower() for p in t.partitions}
    for k, c in enumerate(t.data_columns):
        kind, cell = spark_type(c.type), F.col(f"`{c.name}`")
        v = F.when(cell == "", None).otherwise(cell) if kind == "string" else F.expr(f"try_cast(trim(cast(`{c.name}` as string)) as {kind})")
        if kind in ("tinyint", "smallint", "int", "bigint"):
            v = F.coalesce(v, F.expr(f"try_cast(try_cast(trim(cast(`{c.name}` as string)) as double) as {kind})"))
        if c.has_default and present is not None:
            v = F.when(present <= k, F.expr(default_literal(kind, c.default, True))).otherwise(v)
        out.append(v.alias(c.name))
    return df.select(*out, *(F.col(f"`{p}`").cast("string").alias(p) for p in t.partitions if p.lower() in parts))


def _native(spark: SparkSession, t: Table) -> DataFrame:
    base, pattern, depth = base_of(t), pattern_of(t), len(t.partitions)
    bare = depth > 0 and is_bare(t)
    if t.storage == "gitlfs":
        lfs = GitLfs(t.options)
        files = [lfs.resolve(p) for p in lfs.find(pattern)] if not depth else []
        if depth:
            return _by_file(spark, t)
        if not files:
            raise NoFiles(f"no file {pattern} in {base}")
        paths: list[str] = [os.path.abspath(p) for p in files]
    else:
        if t.storage == "local":
            found = glob.glob(os.path.join(base, *["*"] * depth, pattern)) if not os.path.isfile(base) else [base]
            if not found:
                raise NoFiles(f"no file {pattern} in {base}")
        paths = [os.path.join(base, *["*"] * depth, pattern)] if bare else [base] if depth else [os.path.join(base, pattern)]
        if t.storage == "local":
            paths = [base] if os.path.isfile(base) else paths
            paths = [os.path.abspath(p) for p in paths]
    data = t.data_columns
    schema = ", ".join(f"`{c.name}` string" for c in data)
    reader = spark.read.option("pathGlobFilter", re.sub(r"^.*/", "", pattern)) if depth and not bare else spark.read
    short = t.format == "csv" and any(c.has_default for c in data)
    if t.format == "csv":
        o = t.options
        reader = reader.options(sep=(o.get("delimiter") or ",").encode().decode("unicode_escape"), quote=o.get("quote_char") or '"', escape=o.get("escape_char") or '"', ignoreLeadingWhiteSpace=True, mode="PERMISSIVE", nullValue="", enforceSchema=True, header=int(o.get("skip_lines", 0) or 0) == 1)
        if short:
            reader, schema = reader.option("columnNameOfCorruptRecord", "__line"), f"{schema}, `__line` string"
    if depth and not bare:
        schema += "".join(f", `{p}` string" for p in t.partitions)
        reader = reader.option("basePath", os.path.abspath(base) if t.storage == "local" else base)
    df = getattr(reader.options(**hadoop_options(t)).schema(schema), t.format)(paths)
    if bare:  # values from the path; filters on them prune files
        for k, p in enumerate(t.partitions):
            df = df.withColumn(p, F.element_at(F.split(F.col("_metadata.file_path"), "/"), k - depth - 1))
    present = None
    if t.format == "json" and any(c.has_default for c in data):
        # a key that is missing takes the DEFAULT
        cols = [F.coalesce(F.col(f"`{c.name}`"), F.lit(c.default)).alias(c.name) if c.has_default else F.col(f"`{c.name}`") for c in data]
        df = df.select(*cols, *t.partitions)
    if short:
        sep = re.escape((t.options.get("delimiter") or ",").encode().decode("unicode_escape"))
        present = F.when(F.col("__line").isNull(), F.lit(len(data))).otherwise(F.size(F.split(F.col("__line"), sep)))
    return _typed(t, df, present)


def _by_file(spark: SparkSession, t: Table) -> DataFrame:
    datasources.register(spark)
    s = storage(t.options)
    s.base = base_of(t) if t.storage in ("local", "gitlfs") else s.base
    found = s.find(pattern_of(t), len(t.partitions)) if not os.path.isfile(s.base) else [s.base]
    if not found:
        raise NoFiles(f"no file {pattern_of(t)} in {s.base}")
    files = []
    for p in found:
        folders = p.split("/")[-len(t.partitions) - 1 : -1] if t.partitions else []
        files.append((p, [f.split("=", 1)[1] if "=" in f else f for f in folders]))
    names = [c.name for c in t.data_columns]
    schema = ", ".join([*(f"`{n}` string" for n in names), "`__cells` int", *(f"`{p}` string" for p in t.partitions)])
    df = spark.read.format("tidemill_files").schema(schema).options(table=json.dumps(t.options), names=json.dumps(names), kind=t.format, files=json.dumps(files)).load()
    return _typed(t, df, F.col("__cells"))


def is_jdbc(t: Table) -> bool:
    return t.storage in _JDBC


def jdbc_options(t: Table) -> dict[str, str]:
    o = t.options
    url = f"{_JDBC[t.storage]}://{o.get('host', 'localhost')}:{o.get('port')}/{o.get('database', '')}"
    out = {"url": url + (f"?sslmode={o['sslmode']}" if o.get("sslmode") else "")}
    return out | {k2: o[k] for k, k2 in (("username", "user"), ("password", "password"), ("driver", "driver"), ("partition_column", "partitionColumn"), ("lower_bound", "lowerBound"), ("upper_bound", "upperBound"), ("num_partitions", "numPartitions"), ("fetch_size", "fetchsize")) if o.get(k)}


def _jdbc(spark: SparkSession, t: Table) -> DataFrame:
    r = spark.read.format("jdbc").options(**jdbc_options(t))
    r = r.option("query", t.options["query"].rstrip().rstrip(";")) if t.options.get("query") else r.option("dbtable", t.options.get("table_name") or t.name)
    return r.load().select(*(c.name for c in t.columns))
