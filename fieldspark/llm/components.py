"""Connected components of an edge table, without ever gathering a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Alternating stars: neighbours are hung below the smallest one until every component is a star.
    Only per-node minima are aggregated, so a hub of any degree is pre-aggregated map-side. An
    empty edge table gives an empty result; loops and repeated edges do no harm.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(
        edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges"
    )
    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # a repeated edge does not change the minima; the round's last step removes it
        large = (
            both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).where("a <> b")
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a")
        small = small.select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).union(
            small.select("a", F.col("m").alias("b"))
        )
        edges = stored(small.where("a <> b").distinct(), "edges")
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == tuple(now):
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
