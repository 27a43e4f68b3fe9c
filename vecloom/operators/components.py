"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import drop_table, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Large-star and small-star alternate until neither changes an edge, which takes
    logarithmically many rounds in practice. Stars are formed with grouped minima
    and joins, so a hub's neighbours are never gathered in one task. Self-loops
    count as nodes without edges; null ends are ignored; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = materialize(e.select(F.col("u").alias("node")).union(e.select("v")).distinct(), "cc-nodes")
    now = materialize(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    for _ in range(max_rounds):
        after = materialize(_small_star(_large_star(now)), "cc-edges")
        changed = after.exceptAll(now).limit(1).count() + now.exceptAll(after).limit(1).count()
        drop_table(now)
        now = after
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("component", "node").alias("component"))


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


