"""Connected components of a large graph, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of edges (a, b), both long.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest neighbour, then its smaller ones.  Edges stay as
    many as nodes or fewer after the first rounds, and each round halves the
    depth at least.  A node with very many neighbours is only ever aggregated by
    a minimum, combined before the shuffle.  Each round is stored.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        # large step: larger neighbours (and the node) go to the smallest of node and neighbours
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that both sides of the join are shuffles that Spark can split at a node with very many neighbours
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small step: smaller neighbours and the node go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = stored(small.where("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Every node has one smaller neighbour, and that has none."""
    roles = edges.groupBy(F.col("a").alias("x")).agg(F.count("*").alias("up"), F.lit(0).alias("down")).unionAll(edges.groupBy(F.col("b").alias("x")).agg(F.lit(0).cast("long").alias("up"), F.lit(1).alias("down")))
    open_ = roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
    return open_.isEmpty()
