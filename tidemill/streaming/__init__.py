"""Declared CSV and JSON tables as streams.

The dialect has no windows over unbounded input; a declared table's folder can be
read as a stream with its declared types, and everything Spark offers on streams
applies to it: watermarks, windows, stateful operators, sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Table, spark_type
from ..sources.readers import base_of, pattern_of


def read_stream(spark: SparkSession, t: Table, files_per_trigger: int = 100) -> DataFrame:
    """New files of the table's folder as they come."""
    schema = ", ".join(f"`{c.name}` string" for c in t.data_columns)
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern_of(t).rsplit("/", 1)[-1])
    if t.format == "csv":
        r = r.options(sep=t.options.get("delimiter") or ",", header=t.options.get("skip_lines") == "1", nullValue="")
    df = r.format(t.format).load(base_of(t))
    return df.select(*(F.expr(f"try_cast(`{c.name}` as {spark_type(c.type)})").alias(c.name) for c in t.data_columns))
