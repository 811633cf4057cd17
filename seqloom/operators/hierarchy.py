"""The condensed hierarchy of a minimum spanning forest, and the clusters chosen from it.

Components of the forest are joined up to rising weights, level by level. A
level takes the lighter half of the links that are left, or less, until no
component of it has more than ``level_links`` links; a component is handled in
one task. After a level each of its components is one node, which carries its
open cluster. Only nodes with links at a level travel to it, components without
further links are closed at once, and the links that are left halve from level
to level as long as their components stay small.

Trees of the forest are clusters born at ``max_distance``. Links of equal weight
are taken together within a level, so the result depends on no order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.spanning import forest
from seqloom.session import cut, release


@dataclass
class Part:
    """What a component has come to: its points, its open cluster if it is large enough, else its classes."""

    size: int
    cluster: str | None = None
    total: float = 0.0  # over the points, the densities at which they left the open cluster
    best: float = 0.0  # the stability that selecting below the open cluster would give
    classes: list[int] = field(default_factory=list)


class Hierarchy:
    """Condenses a forest bottom up: links by rising weight, equal weights at once."""

    def __init__(self, min_size: int, floor: float) -> None:
        self.min_size, self.floor = min_size, floor
        self.entries: list[tuple[int, str, float]] = []  # class, the lowest cluster it is in, density of entry
        self.clusters: list[tuple[str, str | None, int, float, float, bool]] = []  # name, parent, size, birth, stability, preferred

    def density(self, weight: float) -> float:
        return 1.0 / (weight + self.floor)

    def start(self, cls: int, size: int) -> Part:
        """A class alone: a cluster if its copies are enough of one."""
        part = Part(size, classes=[cls])
        return self.merge([part], 0.0, f"{cls}:0") if size >= self.min_size else part

    def close(self, part: Part, weight: float, parent: str | None) -> float:
        """Ends an open cluster where a larger one begins; the best stability at or below it."""
        stability = part.total - self.density(weight) * part.size
        preferred = stability >= part.best
        self.clusters.append((part.cluster, parent, part.size, self.density(weight), stability, preferred))
        return max(stability, part.best)

    def merge(self, parts: list[Part], weight: float, name: str) -> Part:
        """Parts that links of one weight join; *name* is a cluster's if one begins here."""
        large = [p for p in parts if p.cluster]
        small = [p for p in parts if not p.cluster]
        density, size = self.density(weight), sum(p.size for p in parts)
        if not large and size < self.min_size:
            return Part(size, classes=sorted(c for p in small for c in p.classes))
        if len(large) == 1:
            out = large[0]
            out.total += density * (size - out.size)
            out.size = size
        else:
            out = Part(size, name, density * size)
            out.best = sum(self.close(p, weight, name) for p in sorted(large, key=lambda p: p.cluster))
        self.entries += [(c, out.cluster, density) for p in small for c in p.classes]
        return out

    def run(self, parts: dict[int, Part], a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> dict[int, int]:
        """Joins *parts* (by node) along the links; each node's root. *parts* keeps the roots' parts."""
        root = {n: n for n in parts}

        def find(n: int) -> int:
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        order = np.lexsort((b, a, weight))
        at = 0
        while at < len(order):
            to = at
            together: dict[int, list[int]] = {}
            while to < len(order) and weight[order[to]] == weight[order[at]]:
                x, y = find(int(a[order[to]])), find(int(b[order[to]]))
                to += 1
                if x != y:
                    x, y = min(x, y), max(x, y)
                    root[y] = x
                    together[x] = together.pop(x, [x]) + together.pop(y, [y])
            w = float(weight[order[at]])
            for x, nodes in together.items():
                joined = [parts.pop(n) for n in nodes]
                parts[x] = self.merge(joined, w, f"{x}:{w!r}")
            at = to
        return {n: find(n) for n in root}


_STATE = "what int, node long, root long, size long, cluster string, total double, best double, classes array<long>, parent string, density double, preferred boolean"
_SCHEMA = pa.schema(
    [
        ("what", pa.int32()), ("node", pa.int64()), ("root", pa.int64()), ("size", pa.int64()), ("cluster", pa.string()), ("total", pa.float64()), ("best", pa.float64()),
        ("classes", pa.list_(pa.int64())), ("parent", pa.string()), ("density", pa.float64()), ("preferred", pa.bool_()),
    ]
)
NODE, ENTRY, CLUSTER = range(3)


def _level(table: pa.Table, min_size: int, floor: float) -> pa.Table:
    """One level for the components of a group: rows of nodes (a null) and links. Arrow all along, as pandas would round long ids beside nulls."""
    h = Hierarchy(min_size, floor)
    is_node = pc.is_null(table["a"])
    nodes, edges = table.filter(is_node), table.filter(pc.invert(is_node))
    parts: dict[int, Part] = {}
    for r in nodes.select(["node", "size", "cluster", "total", "best", "classes"]).to_pylist():
        known = r["total"] is not None
        parts[r["node"]] = Part(r["size"], r["cluster"], r["total"], r["best"], r["classes"] or []) if known else h.start(r["node"], r["size"])
    roots = h.run(parts, *(edges[c].to_numpy() for c in ("a", "b", "weight")))
    out = []
    for n, root in roots.items():
        # a node that is not its component's root is only told the root
        p = parts.get(n) or Part(0)
        out.append({"what": NODE, "node": n, "root": root, "size": p.size, "cluster": p.cluster, "total": p.total, "best": p.best, "classes": p.classes})
    out += [{"what": ENTRY, "node": c, "cluster": name, "density": d} for c, name, d in h.entries]
    out += [{"what": CLUSTER, "size": n, "cluster": name, "total": stability, "parent": up, "density": birth, "preferred": p} for name, up, n, birth, stability, p in h.clusters]
    return pa.Table.from_pylist(out, schema=_SCHEMA)


def _named(cls: Column) -> Column:
    """The name of the cluster that a class's own copies make."""
    return F.concat(cls.cast("string"), F.lit(":0"))


def _threshold(edges: DataFrame, n: int, level_links: int) -> tuple[float | None, DataFrame | None]:
    """The weight up to which the next level goes, and its components (``node, component``); None: all links, whose components are the whole forest's."""
    share = 0.5
    while n > level_links:
        top = edges.agg(F.percentile_approx("weight", F.lit(share), F.lit(10_000))).first()[0]
        trial = forest(edges.where(F.col("weight") <= top))
        release(trial.edges)
        largest = trial.nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if largest - 1 <= level_links or share * n <= level_links:
            return top, trial.nodes
        release(trial.nodes)
        share /= 2
    return None, None


def hierarchy(links: DataFrame, sizes: DataFrame, nodes: DataFrame, min_size: int, max_distance: float, level_links: int = 200_000, floor: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries ``cls, cluster, density`` and clusters ``cluster, parent, size, birth, stability, preferred`` of a forest.

    *links*: ``a, b, weight`` of the forest; *nodes*: ``node, component`` of its ends;
    *sizes*: ``cls, n`` of all classes.
    """
    floor = max_distance * 1e-3 if floor is None else floor
    none = F.lit(None)
    birth = 1.0 / (max_distance + floor)
    blank = [none.cast("string").alias("cluster"), none.cast("double").alias("total"), none.cast("double").alias("best"), none.cast("array<long>").alias("classes")]

    def closed(tops: DataFrame) -> DataFrame:
        stability = F.col("total") - F.lit(birth) * F.col("size")
        return tops.where("cluster is not null").select("cluster", none.cast("string").alias("parent"), "size", F.lit(birth).alias("birth"), stability.alias("stability"), (stability >= F.col("best")).alias("preferred"))

    ends = nodes.select(F.col("node").alias("cls"))
    # classes without a link are clusters only by their copies
    alone = sizes.join(ends, "cls", "left_anti").where(F.col("n") >= min_size).select("cls", F.col("n").cast("long").alias("size"), _named(F.col("cls")).alias("cluster"))
    entries = [alone.select("cls", "cluster", F.lit(1.0 / floor).alias("density"))]
    clusters = [closed(alone.select("cluster", "size", (F.col("size") / F.lit(floor)).alias("total"), F.lit(0.0).alias("best")))]
    state = sizes.join(ends, "cls", "left_semi").select(F.col("cls").alias("node"), F.col("n").cast("long").alias("size"), *blank)
    edges, n = links.select("a", "b", "weight"), links.count()
    while n:
        top, trees = _threshold(edges, n, level_links)
        now = edges if top is None else edges.where(F.col("weight") <= top)
        trees = nodes if trees is None else trees
        group = F.pmod(F.xxhash64("component"), F.lit(16 * max(1, -(-n // level_links)))).alias("g")
        keyed = state.join(trees, "node")
        rows = keyed.select(group, "node", "size", "cluster", "total", "best", "classes", none.cast("long").alias("a"), none.cast("long").alias("b"), none.cast("double").alias("weight"))
        wired = now.join(trees.select(F.col("node").alias("a"), "component"), "a").select(group, none.cast("long").alias("node"), none.cast("long").alias("size"), *blank, "a", "b", "weight")
        done = cut(rows.unionByName(wired).groupBy("g").applyInArrow(lambda t: _level(t, min_size, floor), _STATE))
        entries.append(done.where(f"what = {ENTRY}").select(F.col("node").alias("cls"), "cluster", "density"))
        clusters.append(done.where(f"what = {CLUSTER}").select("cluster", "parent", "size", F.col("density").alias("birth"), F.col("total").alias("stability"), "preferred"))
        tops = done.where(f"what = {NODE} and node = root").select("node", "size", "cluster", "total", "best", "classes")
        if top is None:
            clusters.append(closed(tops))
            break
        root = done.where(f"what = {NODE}").select("node", "root")
        at = lambda s: root.select(F.col("node").alias(s), F.col("root").alias(f"r{s}"))
        before = edges, state
        edges = cut(edges.where(F.col("weight") > top).join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "weight"))
        open_ = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        clusters.append(cut(closed(tops.join(open_, "node", "left_anti"))))
        state = cut(state.join(trees.select("node"), "node", "left_anti").unionByName(tops).join(open_, "node", "left_semi"))
        release(*before)
        n = edges.count()
    out_e, out_c = entries[0], clusters[0]
    for e in entries[1:]:
        out_e = out_e.unionByName(e)
    for c in clusters[1:]:
        out_c = out_c.unionByName(c)
    return out_e, cut(out_c)


def select_stable(clusters: DataFrame) -> DataFrame:
    """``cluster, chosen``: for each cluster the topmost preferred one above or at it, null if there is none."""
    at = cut(clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("preferred"), F.col("cluster")).alias("chosen")))
    while not at.where("up is not null").isEmpty():
        above = at.select(F.col("cluster").alias("up"), F.col("up").alias("further"), F.col("chosen").alias("higher"))
        before, at = at, cut(at.join(above, "up", "left").select("cluster", F.col("further").alias("up"), F.coalesce("higher", "chosen").alias("chosen")))
        release(before)
    return at.select("cluster", "chosen")


def select_roots(clusters: DataFrame) -> DataFrame:
    """``cluster, chosen``: for each cluster the one at the top of its tree, that is the hierarchy cut at ``max_distance``."""
    return select_stable(clusters.withColumn("preferred", F.lit(True)))
