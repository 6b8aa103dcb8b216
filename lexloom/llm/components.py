"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Edges (u, v) with u > v. Large star: each neighbour above a node is linked to the least node near it; small star: those below."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    near = both.join(least, F.col("u") == F.col("c"))
    if small:
        out = near.select("v", "m").unionByName(least.select(F.col("c").alias("v"), "m"))
    else:
        out = near.where("v > u").select("v", "m")
    return out.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node that it reaches) for each node of ``edges`` (columns u, v of one orderable type).

    Every round is two joins, spread by node and summed before the shuffle, and its result is kept in the shared folder. The rounds
    grow with the logarithm of the number of nodes; they end when a round changes nothing. Self-links and null ends are dropped.
    """
    edges = settle(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while (now := _mark(edges)) != last and now[0]:
        last = now
        edges = settle(_star(_star(edges, small=False), small=True))
    own = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
