"""Connected components of an edge table by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """Large star: each node's greater neighbours to its least; small star: its lesser neighbours and itself. A node's neighbours are not gathered:
    the least is an aggregate, saved and joined back, and nodes of very many edges are joined by broadcast, as there are few."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = common.saved(both.groupBy("a").agg((F.least(F.min("b"), F.col("a")) if large else F.min("b")).alias("m"), F.count("*").alias("degree")), "least")
    joined = common.join_one(both, least, "a", "degree", 2 * n, "inner")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return common.saved(out.where("a <> b").distinct(), "edges")


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """edges: a, b (any ordered type). Returns node, label: the least node of its component, for every node of an edge between different nodes.

    Each star writes its edges to the shared folder; rounds end when a digest of the edges no longer changes, after about the logarithm of
    the longest path. Loops and repeated edges do nothing; no edges give no rows.
    """
    edges = common.saved(edges.select("a", "b").dropna().where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = digest(edges)
    for _ in range(most):
        if not before[0]:
            break
        edges = _star(_star(edges, before[0], True), before[0], False)
        now = digest(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
