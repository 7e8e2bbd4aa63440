"""Connected components of an edge table, as alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from photonflow.llm.common import cut, discard


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: columns a, b (long). Returns node, component: the smallest node reachable.

    Only nodes with an edge to another node are returned. Each round ends in the shared folder. A round keeps at most
    one edge for each edge it read, and every node's minimum is pre-aggregated before the shuffle, so that a hub costs
    its neighbours' rows and no more. Nulls and self edges are ignored; no edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges, "edges")
    before = _state(edges)
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        small = small.unionAll(low.select("a", F.col("m").alias("b")))
        last, edges = edges, cut(small.where("a <> b").distinct(), "edges")
        discard(last)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
