"""Nearest-neighbour graphs as edge tables ``src, dst, distance, rank`` (rank 1 is the nearest)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import cut, release


def mutual(edges: DataFrame, keep_n: int) -> DataFrame:
    """Edges whose reverse exists too, and each node's *keep_n* nearest anyway."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = edges.join(back.distinct(), ["src", "dst"], "left_semi")
    return both.where(F.col("rank") > keep_n).unionByName(edges.where(F.col("rank") <= keep_n))


def intersect(base: DataFrame, other: DataFrame, keep_n: int) -> DataFrame:
    """Edges of *base* whose reverse is in *other*, and each node's *keep_n* nearest anyway."""
    back = other.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = base.join(back.distinct(), ["src", "dst"], "left_semi")
    return both.where(F.col("rank") > keep_n).unionByName(base.where(F.col("rank") <= keep_n))


def combined(depth: DataFrame, tnf: DataFrame, keep_n: int, prune: bool = True) -> DataFrame:
    """The depth graph cut by the k-mer graph, then to mutual edges. Without *prune*, the depth graph as it is."""
    return mutual(intersect(depth, tnf, max(keep_n, 5)), keep_n) if prune else depth


def disconnected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (``src``) without an edge of their own."""
    return nodes.select("src").join(edges.select("src").distinct(), "src", "left_anti")


def prefilter(nodes: DataFrame, build: Callable[[DataFrame, int], DataFrame], keep_n: int, step: int, rounds: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Removes disconnected nodes and builds the graph again, until none is left: nodes, edges, removed nodes.

    After *rounds* rounds *keep_n* grows by *step* each time; every round removes
    nodes, so the loop ends, at the latest with no node.
    """
    nodes, removed = cut(nodes.select("src").distinct()), []
    while True:
        edges = cut(build(nodes, keep_n))
        alone = cut(disconnected(nodes, edges))
        if alone.isEmpty():
            break
        release(edges)
        removed.append(alone)
        before, nodes = nodes, cut(nodes.join(alone, "src", "left_anti"))
        release(before)
        keep_n += step if len(removed) >= rounds else 0
    gone = nodes.limit(0)
    for r in removed:
        gone = gone.unionByName(r)
    return nodes, edges, gone
