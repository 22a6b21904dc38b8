"""Connected components of an edge list, for graphs that don't fit a machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps: each links a node's neighbours to the smallest of
    them, so the number of rounds grows with the logarithm of a component's size. Every round is
    written to the shared folder. Self-links and repeated links are allowed; no links give no rows. A
    graph that isn't done after ``rounds`` is an error, not a partial answer.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = cut(links, "links")
    before = None
    for _ in range(rounds):
        # Large star: larger neighbours of a node go to its smallest neighbour (or itself).
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        roots = state.where("u = v")
        large = large.unionByName(roots).distinct()
        # Small star: smaller neighbours and the node itself go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        state = cut(small, "links")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
