"""Connected components of an edge table by alternating stars.

Each round hangs every node's larger neighbours on its least neighbour, then
every node and its smaller neighbours on the least of them, until nothing
changes; rounds grow with the logarithm of a component's size. Only aggregates
per node and joins on nodes are used, so a node with very many edges is
pre-aggregated and its rows can be split; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    lower = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """``edges`` (a, b: long) -> (node, component): the least node of each component; only nodes with edges other than the least."""
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-0")
    mark, rounds = None, 0
    while True:
        rounds += 1
        after = scratch.table(_small(_large(now)), f"{tag}-{rounds}")
        scratch.drop(f"{tag}-{rounds - 1}")
        got = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = after
        if tuple(got) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = tuple(got)
