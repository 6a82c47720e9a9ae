"""Connected components over an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (node, root), root the smallest id reachable, roots themselves included; ids without links are absent.

    Each half round groups and joins by one endpoint and removes repeats; no component, however
    large, is gathered in one task. The rounds are logarithmic in a component's size.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        large = materialize(_large_star(edges), "large-star")
        small = materialize(_small_star(large), "small-star")
        drop_written(large)
        drop_written(edges)
        edges, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    root = F.col("b").alias("root")
    return edges.select(F.col("a").alias("node"), root).union(edges.select(F.col("b").alias("node"), root).distinct())
