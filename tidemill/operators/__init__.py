"""The dialect's operators for DataFrames: joins with default fill and typed keys, text explosion, equal-width histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rewrite import default_literal

__all__ = ["explode_map_text", "explode_text", "histogram", "join_with_defaults", "key"]


def key(df: DataFrame, name: str) -> Column:
    """A join key by its type: text without blanks around it."""
    c = df[name]
    return F.trim(c) if df.schema[name].dataType.simpleString() == "string" else c


def join_with_defaults(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left", defaults: dict[str, str | None] | None = None, suffix: str = "_right") -> DataFrame:
    """An equi-join whose missing side is filled by type (0, false, '') or by `defaults`, not by NULL.

    A marker tells a missing side from NULLs in a matched row. Names of the right side
    that the left has too get the suffix. Catalyst chooses the join.
    """
    kinds = {"inner", "left", "right", "full", "left_semi", "left_anti", "cross"}
    if how not in kinds:
        raise ValueError(f"{how} isn't one of {sorted(kinds)}")
    if how == "cross":
        return left.crossJoin(right.toDF(*(f"{c}{suffix}" if c in left.columns else c for c in right.columns)))
    if how in ("left_semi", "left_anti"):
        return left.join(right.select(key(right, right_key).alias("__k")), key(left, left_key) == F.col("__k"), how)
    names = [f"{c}{suffix}" if c in left.columns else c for c in right.columns]
    a = left.withColumns({"__k": key(left, left_key), "__l": F.lit(True)})
    b = right.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(right.columns, names)), key(right, right_key).alias("__k2"), F.lit(True).alias("__r"))
    j = a.join(b, F.col("__k") == F.col("__k2"), how)
    defaults = defaults or {}

    def fill(name: str, kind: str, mark: str) -> Column:
        d = F.expr(default_literal(kind, defaults.get(name), name in defaults))
        return F.when(F.col(mark).isNull(), d).otherwise(F.col(f"`{name}`")).alias(name)

    out = [fill(f.name, f.dataType.simpleString(), "__l") if how in ("right", "full") else F.col(f"`{f.name}`") for f in left.schema]
    out += [fill(n, f.dataType.simpleString(), "__r") if how in ("left", "full") else F.col(f"`{n}`") for f, n in zip(right.schema, names)]
    return j.select(*out)


def _parts(text: str) -> Column:
    return F.transform(F.split(F.nullif(F.col(f"`{text}`").cast("string"), F.lit("")), ","), lambda x: F.trim(x))


def explode_text(df: DataFrame, column: str, alias: str, outer: bool = False, position: str | None = None) -> DataFrame:
    """One row per item of comma-separated text; outer keeps rows without items; position names a column of places from 0."""
    if position:
        f = F.posexplode_outer if outer else F.posexplode
        return df.select("*", f(_parts(column)).alias(position, alias))
    return df.select("*", (F.explode_outer if outer else F.explode)(_parts(column)).alias(alias))


def explode_map_text(df: DataFrame, column: str, key_alias: str, value_alias: str) -> DataFrame:
    """One row per pair of k,v,k,v text; an odd tail is dropped."""
    p = _parts(column)
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.floor(F.size(p) / 2).cast("int") - 1, F.lit(0))), lambda i: 2 * i + 1 < F.size(p)), lambda i: F.struct(F.get(p, 2 * i).alias(key_alias), F.get(p, 2 * i + 1).alias(value_alias)))
    return df.select("*", F.inline(pairs))


def histogram(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """bucket, low, high, n over buckets of equal width, empty ones too. Two aggregations; no value list is ever in one place."""
    x = F.col(f"`{column}`").cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / buckets
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / F.when(width == 0, 1).otherwise(width)).cast("int"), F.lit(buckets - 1)))
    counted = df.select(x.alias("v")).where("v is not null").crossJoin(F.broadcast(ends)).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    frame = ends.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")).where((F.col("lo") != F.col("hi")) | (F.col("bucket") == 0))
    return frame.join(counted, "bucket", "left").select("bucket", (F.col("lo") + F.col("bucket") * width).alias("low"), (F.col("lo") + (F.col("bucket") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
