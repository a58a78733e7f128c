"""Connected components of a links table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rounds grow with the logarithm of the longest chain; a table that takes more than these isn't settled, which is an error.
ROUNDS_MOST = 60


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (u, v: two longs); root is the smallest node that links reach.

    Minima come from aggregates that combine before they shuffle, and joins of plain tables, whose hot keys adaptive
    execution can split. Each round is written to the shared folder; the driver sees two numbers of it. Rows with a null,
    loops and repeats of a link count for nothing. No links, no rows.
    """
    edges = materialise(links.filter("u <> v").select("u", "v").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    for round_ in range(ROUNDS_MOST + 1):
        if round_ == ROUNDS_MOST:
            raise RuntimeError(f"links have not settled after {ROUNDS_MOST} rounds")
        edges = materialise(_small(_large(edges)), "stars")
        # two rounds with the same links: only stars are left
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
