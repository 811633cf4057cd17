"""Minimum spanning forests: of edge tables by Borůvka's rounds, of matrices and link arrays in numpy.

Each round takes every component's least edge (by weight, then ends, so that
all edges differ), joins the components along these, and renames the ends of
the edges that are left. Components halve at least, so rounds are few; edges
within a component leave at once, and of the edges between two components only
the least stays. Each round is kept in the shared folder.

Defined results: edges with a null end or weight, and loops, are ignored;
repeated edges count once. A component is named by its smallest node.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import cut, release


@dataclass
class Forest:
    """``edges``: a, b, weight of the forest. ``nodes``: node, component, of all nodes with an edge."""

    edges: DataFrame
    nodes: DataFrame


def _roots(hooks: DataFrame) -> DataFrame:
    """``c, root`` from the hooks ``c, other``: the two that hook each other are the root, and pointers are doubled to it."""
    # the pair that chose the same edge from both ends: the smaller one stays
    back = hooks.select(F.col("other").alias("c"), F.col("c").alias("other"), F.lit(True).alias("both"))
    at = cut(hooks.join(back, ["c", "other"], "left").select("c", F.when(F.col("both") & (F.col("c") < F.col("other")), F.col("c")).otherwise(F.col("other")).alias("root")))
    while True:
        # two doublings a round: a pointer's target's target, and that one's again
        two = at.select(F.col("c").alias("root"), F.col("root").alias("far"))
        twice = at.join(two, "root").select("c", F.col("root").alias("was"), F.col("far").alias("root"))
        four = twice.select(F.col("c").alias("root"), F.col("root").alias("far"))
        before, at = at, cut(twice.join(four, "root").select("c", F.col("far").alias("root"), (F.col("far") != F.col("was")).alias("moved")))
        release(before)
        if at.where("moved").isEmpty():
            return at


def forest(edges: DataFrame) -> Forest:
    """The minimum spanning forest of ``a, b, weight``."""
    ends = edges.where("a is not null and b is not null and a <> b and weight is not null and not isnan(weight)")
    left = ends.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("weight").alias("weight"))
    left = cut(left.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "weight", "a", "b"))
    kept, maps = [], []
    while not left.isEmpty():
        key = F.struct("weight", "a", "b", F.col("cb").alias("other"))
        swapped = F.struct("weight", "a", "b", F.col("ca").alias("other"))
        both = left.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), key.alias("e")), F.struct(F.col("cb").alias("c"), swapped.alias("e")))).alias("x"))
        least = cut(both.groupBy("x.c").agg(F.min("x.e").alias("e")).select("c", F.col("e.other").alias("other"), "e.weight", "e.a", "e.b"))
        kept.append(least)
        root = _roots(least.select("c", "other"))
        maps.append(root)
        to_a, to_b = root.select(F.col("c").alias("ca"), F.col("root").alias("ra")), root.select(F.col("c").alias("cb"), F.col("root").alias("rb"))
        renamed = left.join(to_a, "ca").join(to_b, "cb").where("ra <> rb")
        pair = [F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb")]
        before, left = left, cut(renamed.groupBy(*pair).agg(F.min(F.struct("weight", "a", "b")).alias("e")).select("ca", "cb", "e.weight", "e.a", "e.b"))
        release(before)
    if not kept:
        return Forest(left.select("a", "b", "weight"), left.select(F.col("ca").alias("node"), F.col("cb").alias("component")))
    # the last round's roots are final; every round before is led on to them
    final = maps[-1]
    for m in reversed(maps[:-1]):
        later = final.select(F.col("c").alias("root"), F.col("root").alias("far"))
        final = m.join(later, "root", "left").select("c", F.coalesce("far", "root").alias("root"))
    tree = kept[0].select("a", "b", "weight")
    for k in kept[1:]:
        tree = tree.unionByName(k.select("a", "b", "weight"))
    named = final.groupBy("root").agg(F.min("c").alias("component"))
    nodes = final.join(named, "root").select(F.col("c").alias("node"), "component")
    out = Forest(cut(tree.distinct()), cut(nodes))
    release(*kept, *maps)
    return out


def dense_forest(d: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Prim's forest of a full symmetric distance matrix, links up to *most*: the links' ends."""
    n = len(d)
    key, via, out = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    ends: list[tuple[int, int]] = []
    for _ in range(n):
        at = int(key.argmin())
        if key[at] > most:
            at = int(out.argmax())  # a new tree
        else:
            ends.append((via[at], at))
        out[at] = False
        key[at] = np.inf
        nearer = out & (d[at] < key)
        key[nearer] = d[at][nearer]
        via[nearer] = at
    return _ends(ends)


def cross_forest(d: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Prim's forest of a graph of links between rows and columns only: the links' rows and columns."""
    r, c = d.shape
    flip = np.ascontiguousarray(d.T)
    key, via, out = np.full(r + c, np.inf), np.full(r + c, -1), np.ones(r + c, bool)
    ends: list[tuple[int, int]] = []
    for _ in range(r + c):
        at = int(key.argmin())
        if key[at] > most:
            at = int(out.argmax())
        else:
            ends.append((at, via[at]) if at < r else (via[at], at))
        out[at] = False
        key[at] = np.inf
        far, row = (slice(r, None), d[at]) if at < r else (slice(0, r), flip[at - r])
        nearer = out[far] & (row < key[far])
        key[far][nearer] = row[nearer]
        via[far][nearer] = at
    i, j = _ends(ends)
    return i, j - r


def _ends(ends: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    both = np.array(ends, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def sparse_forest(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which of the links (i, j, w) of n nodes a minimum spanning forest keeps; Borůvka's rounds on arrays."""
    order = np.argsort(w, kind="stable")
    i, j = i[order], j[order]
    label, alive, kept = np.arange(n), np.arange(len(i)), [np.zeros(0, np.int64)]
    while True:
        a, b = label[i[alive]], label[j[alive]]
        across = a != b
        a, b, alive = a[across], b[across], alive[across]
        if not len(alive):
            return order[np.concatenate(kept)]
        # links are in order, so written backwards each part ends up with its first
        first = np.full(n, len(i))
        first[b[::-1]] = alive[::-1]
        other = np.full(n, len(i))
        other[a[::-1]] = alive[::-1]
        first = np.minimum(first, other)
        parts = np.flatnonzero(first < len(i))
        link = first[parts]
        kept.append(np.unique(link))
        x, y = label[i[link]], label[j[link]]
        up = np.arange(n)
        up[parts] = np.where(x == parts, y, x)
        # two parts that chose the same link point at each other: the smaller is the root
        pair = (up[up] == np.arange(n)) & (np.arange(n) < up)
        up[pair] = np.flatnonzero(pair)
        while True:
            far = up[up]
            if (far == up).all():
                break
            up = far
        label = up[label]
