"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut


def _is_done(edges: DataFrame) -> bool:
    """Whether each node hangs on one root, which hangs on nothing."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("top")))
    return ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("top").alias("top")).where("low > 1 or (low = 1 and top = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); component is the smallest node reached.

    Each round hangs a node's larger neighbours on its smallest one, then its
    smaller neighbours; the number of rounds grows with the logarithm of the
    longest path. The edges of a round are written to the shared folder. It ends when
    all edges lead from a node to the smallest one of its component.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut(both)
    while not _is_done(now):
        # Large star: all larger neighbours of a node go to the smallest of it and its neighbours.
        sides = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = sides.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        now = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
