"""Connected components of a large graph by alternating large-star and small-star steps on a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT_PART, Workspace

HUB = 1000
"""Nodes of up to so many edges are no hubs."""


def _stars(edges: DataFrame, large: bool, count: int) -> DataFrame:
    """One star step.  Edges are (a, b) with a > b; every edge of a node is redirected to the node's smallest neighbour.

    The smallest neighbour is a map-side combined ``min`` joined back on the node; hubs, of more than one in 10,000 edges, are joined
    by broadcast, so a hub's edges are never in one task.
    """
    near = edges.select("a", "b")
    if large:
        near = near.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    if count > HUB:
        hub = F.col("n") > max(HUB, count // HOT_PART)
        hubs = F.broadcast(least.where(hub).drop("n"))  # at most twice HOT_PART
        rest = near.join(hubs.select("a"), "a", "left_anti").join(least.where(~hub).drop("n"), "a")
        moved = near.join(hubs, "a").unionByName(rest)
    else:
        moved = near.join(least.drop("n"), "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(links: DataFrame, work: Workspace) -> DataFrame:
    """Rows (node, component) for each node of ``links`` (columns a and b, any order): component is its smallest node.

    Steps repeat until the edges stay the same, after a number of rounds about the logarithm of the longest chain.  Each round is
    written to the shared folder, and only a count and a checksum reach the driver.  No links: no rows.
    """
    edges = work.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    seen, k = None, 0
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, k = mark, k + 1
        half = work.keep(_stars(edges, True, mark[0]), f"half-{k}")
        edges = work.keep(_stars(half, False, mark[0]), f"edges-{k}")
        work.drop(f"half-{k}")
        if k > 1:
            work.drop(f"edges-{k - 2}")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
