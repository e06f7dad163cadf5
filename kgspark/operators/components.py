"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.shared import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is the smallest node reachable.

    Each round points every node to its smallest neighbour, follows that pointer once more and contracts the
    edges, so that the edge table shrinks geometrically. Minima are pre-aggregated before each shuffle and the
    joins have one row per node on one side, so a hub with very many edges is split by adaptive execution.
    Nulls and self loops are dropped (a node with only a self loop keeps itself); an empty table gives an empty one.
    """
    kind = edges.schema[src].dataType
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).cast(kind).alias("b")).where("a is not null and b is not null")
    loops = pairs.where("a = b").select("a")
    live = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("up")), "up")
        jump = cut(
            up.hint("merge").join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "top"),
            "jump",
        )
        labels = jump.select("node", F.col("top").alias("component")) if labels is None else _compose(labels, jump)
        a = live.hint("merge").join(jump.select(F.col("node").alias("a"), F.col("top").alias("x")), "a").select("x", "b")
        b = a.hint("merge").join(jump.select(F.col("node").alias("b"), F.col("top").alias("y")), "b").select("x", "y").where("x <> y")
        live = cut(b.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    if labels is None:
        return loops.distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    lone = loops.distinct().join(labels.select(F.col("node").alias("a")), "a", "left_anti")
    return labels.unionByName(lone.select(F.col("a").alias("node"), F.col("a").alias("component")))


def _compose(labels: DataFrame, jump: DataFrame) -> DataFrame:
    step = jump.select(F.col("node").alias("component"), "top")
    joined = labels.hint("merge").join(step, "component", "left")
    return cut(joined.select("node", F.coalesce("top", "component").alias("component")), "labels")
