"""Connected components of an edge table, as joins over the edges that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b): the component is the smallest node that links reach.

    Large-star and small-star rounds: every node points to the smallest neighbour it has seen, until nothing
    changes. The edges never grow, a round is two aggregates and two joins on node keys, and each round's
    edges are cut by a checkpoint. A node with very many edges is reduced by map-side minima; joins on it are
    left to the skew handling of the session. Null ends and self-links are ignored.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null")
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    now = cut(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: the larger neighbours of u point to the smallest of u and its neighbours.
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = cut(small.filter("u <> v").distinct())
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
