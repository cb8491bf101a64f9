"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> tuple[DataFrame, str | None]:
    """From edges (a, b): (node, root) for every node with an edge, root the smallest node it reaches. Also the place of the written table.

    A round takes two partial aggregations and two equi-joins, so that a node with
    very many edges is pre-aggregated and its join partition can be split. Every round
    links nodes to smaller ones; it ends when a round changes nothing.
    """
    edges = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, place = common.keep(edges, "edges")
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = sign(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        after, new_place = common.keep(small.select("a", F.col("m").alias("b")).union(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        s = sign(after)
        common.drop_folder(edges.sparkSession, place)
        now, place = after, new_place
        if s == before:
            break
        before = s
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots, place


def with_roots(roots: DataFrame) -> DataFrame:
    """(node, root) with the roots themselves."""
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
