"""Density clustering of points: one fit, a grid of fits and fits per bin in numpy, and one fit over many tasks.

What runs in one task takes at most ``MAX_POINTS`` (more is an error, never a
cut); ``unbounded`` takes any number: all pairs of blocks of points, of which
only the nearest distances and spanning forests leave a task. Definitions of Campello, Moulavi and Sander: the core distance is to the
``min_samples``-th nearest, the point itself counted; clusters are chosen by
excess of mass; the root is no cluster unless ``allow_single``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators import blocks as B
from seqloom.operators.hierarchy import hierarchy, select_stable
from seqloom.operators.spanning import cross_forest, dense_forest, forest
from seqloom.operators.tables import numbered
from seqloom.session import cut

MAX_POINTS, BLOCK = 20_000, 2048


def checked(n: int) -> None:
    if n > MAX_POINTS:
        raise ValueError(f"{n} points in one task; at most {MAX_POINTS} are allowed")


def pairwise(x: np.ndarray) -> np.ndarray:
    """Euclidean distances, NaN as 0."""
    square = (x * x).sum(1)
    d = np.sqrt(np.maximum(square[:, None] + square - 2 * (x @ x.T), 0))
    np.fill_diagonal(d, 0)
    return np.nan_to_num(d, nan=0.0)


def spanning_tree(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's tree of a full distance matrix, edges by rising weight."""
    n = len(d)
    key, via = d[0].copy(), np.zeros(n, np.int64)
    out = np.ones(n, bool)
    out[0] = False
    a, b, w = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64), np.empty(n - 1)
    for k in range(n - 1):
        at = int(np.where(out, key, np.inf).argmin())
        a[k], b[k], w[k] = via[at], at, key[at]
        out[at] = False
        nearer = out & (d[at] < key)
        key[nearer], via[nearer] = d[at][nearer], at
    order = np.argsort(w, kind="stable")
    return a[order], b[order], w[order]


def fit(d: np.ndarray, min_samples: int, min_size: int, allow_single: bool = False, core: np.ndarray | None = None) -> np.ndarray:
    """Labels 0, 1, ... by smallest point, -1 for outliers."""
    n = len(d)
    checked(n)
    if n < max(2, min_size):
        return np.full(n, -1)
    core = np.partition(d, min(min_samples, n) - 1, axis=1)[:, min(min_samples, n) - 1] if core is None else core
    a, b, w = spanning_tree(np.maximum(np.maximum(d, core[:, None]), core))
    lam = 1.0 / np.maximum(w, 1e-12)
    root, size = np.arange(n), np.ones(n, np.int64)
    points = {i: [i] for i in range(n)}  # of parts that are no cluster yet
    cluster: dict[int, int] = {}  # open cluster of a part
    mass: list[float] = []
    best: list[float] = []
    owned: list[list[int]] = []
    kids: list[list[int]] = []
    chosen: list[bool] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def close(part: int, at: float) -> int:
        c = cluster.pop(part)
        stability = mass[c] - at * size[part]
        chosen[c] = stability >= best[c]
        best[c] = max(stability, best[c])
        return c

    for k in range(n - 1):
        x, y = find(a[k]), find(b[k])
        big = [p for p in (x, y) if p in cluster]
        total = size[x] + size[y]
        loose = points.pop(x, []) + points.pop(y, [])
        if len(big) == 1:
            c = cluster.pop(big[0])
            mass[c] += lam[k] * (total - size[big[0]])
            owned[c] += loose
        elif len(big) == 2 or total >= min_size:
            below = [close(p, lam[k]) for p in big]
            c = len(mass)
            mass.append(lam[k] * total)
            best.append(sum(best[i] for i in below))
            owned.append(loose)
            kids.append(below)
            chosen.append(False)
        else:
            c = -1
        root[y], size[x] = x, total
        if c < 0:
            points[x] = loose
        else:
            cluster[x] = c
    labels = np.full(n, -1)
    top = find(0)
    if top not in cluster:
        return labels
    whole = close(top, 0.0)
    stack = [(whole, -1)]
    if not allow_single:
        chosen[whole] = False
    found = 0
    while stack:
        c, label = stack.pop()
        if label < 0 and chosen[c]:
            label, found = found, found + 1
        labels[owned[c]] = label
        stack += [(i, label) for i in kids[c]]
    known = [v for v in pd.unique(pd.Series(labels)) if v >= 0]
    renumber = {v: i for i, v in enumerate(known)}
    return np.array([renumber.get(v, -1) for v in labels])


def silhouette(d: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Per point (b - a) / max(a, b); 0 for outliers, for points alone in their cluster and for a single cluster."""
    known = np.unique(labels[labels >= 0])
    out = np.zeros(len(labels))
    if len(known) < 2:
        return out
    hot = (labels[:, None] == known).astype(float)
    n = hot.sum(0)
    total = d @ hot
    rows = np.flatnonzero(labels >= 0)
    own = np.searchsorted(known, labels[rows])
    mean = total[rows] / n
    a = np.divide(total[rows, own], n[own] - 1, out=np.zeros(len(rows)), where=n[own] > 1)
    mean[np.arange(len(rows)), own] = np.inf
    b = mean.min(1)
    top = np.maximum(a, b)
    out[rows] = np.where((n[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0)
    return out


def grid_scores(rows: DataFrame, id_: str, vec: str, sizes: range = range(2, 12), samples: range = range(5, 15)) -> DataFrame:
    """``min_cluster_size, min_samples, score, n_clusters, n_outliers`` of every fit; a task takes one ``min_samples``.

    The score is the sum of silhouettes over the number of all points, NaN as 0.
    """
    grid = rows.sparkSession.createDataFrame([(s,) for s in samples], "min_samples int")
    slim = rows.select(F.col(id_).alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("id is not null and vec is not null")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        checked(len(pdf))
        d = pairwise(np.stack(pdf.vec.to_numpy()))
        m = int(pdf.min_samples.iloc[0])
        out = []
        for size in sizes:
            labels = fit(d, m, size)
            score = silhouette(d, labels).sum() / len(labels)
            out.append((size, m, float(np.nan_to_num(score)), int(labels.max() + 1), int((labels < 0).sum())))
        return pd.DataFrame(out, columns=["min_cluster_size", "min_samples", "score", "n_clusters", "n_outliers"])

    # a copy of a bounded set for each of a few grid values
    spread = slim.crossJoin(F.broadcast(grid))
    return spread.groupBy("min_samples").applyInPandas(run, "min_cluster_size int, min_samples int, score double, n_clusters int, n_outliers int")


def cluster_groups(rows: DataFrame, keys: list[str], id_: str, vec: str, min_samples: int = 5, min_size: int = 2, allow_single: bool = False, choose: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``keys, id, label`` (null for outliers) of a fit per group; groups of more than MAX_POINTS are an error.

    *choose* replaces the single fit by another labelling of a distance matrix.
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        checked(len(pdf))
        d = pairwise(np.stack(pdf.vec.to_numpy()))
        labels = choose(d) if choose else fit(d, min_samples, min_size, allow_single)
        return pdf[[*keys, "id"]].assign(label=pd.array(np.where(labels < 0, 0, labels), dtype="Int32")).assign(label=lambda x: x.label.mask(labels < 0))

    slim = rows.select(*keys, F.col(id_).alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    return slim.groupBy(*keys).applyInPandas(run, f"{kinds}, id long, label int")


def best_labels(d: np.ndarray, sizes: range = range(2, 12), samples: range = range(5, 15)) -> np.ndarray:
    """Labels of the grid's fit of the best silhouette, the first on ties."""
    best, out = -np.inf, np.full(len(d), -1)
    for m in samples:
        core = np.partition(d, min(m, len(d)) - 1, axis=1)[:, min(m, len(d)) - 1]
        for size in sizes:
            labels = fit(d, m, size, core=core)
            score = np.nan_to_num(silhouette(d, labels).sum() / max(len(d), 1))
            if score > best:
                best, out = score, labels
    return out


def _pairs(packed: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], tuple[np.ndarray, ...]], dims: int, schema: str) -> DataFrame:
    """*kernel* on the ids and points of every pair of blocks (both in one order), told whether both are the same."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, t, i=i, batch=batch: np.frombuffer(batch.column(c)[i].as_py(), t)
                own = batch.column("block_a")[i].as_py() == batch.column("block_b")[i].as_py()
                out = kernel(get("ids_a", np.int64), get("mat_a", float).reshape(-1, dims), get("ids_b", np.int64), get("mat_b", float).reshape(-1, dims), own)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    side = lambda s: packed.select(*(F.col(c).alias(f"{c}_{s}") for c in ("block", "ids", "mat")))
    return side("a").join(side("b"), F.col("block_a") <= F.col("block_b")).mapInArrow(run, schema)


def unbounded(rows: DataFrame, min_samples: int = 5, min_size: int = 5, level_links: int = 200_000) -> DataFrame:
    """``id, label`` (null for outliers) of any number of points ``id, vec`` as ``fit`` defines them, over as many tasks as there are pairs of blocks.

    Labels 0, 1, ... go by smallest id. The pairs of blocks grow with the square of
    the points, what leaves their tasks in proportion to blocks times points.
    Points without an id or a vector are left out; null and NaN values are 0;
    ids are to be distinct.
    """
    rows = cut(rows.where("id is not null and vec is not null").select(F.col("id").cast("long").alias("id"), F.transform("vec", lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))).alias("vec")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
    n, dims = size["n"], size["dims"]
    if n < max(2, min_size):
        return rows.select("id", F.lit(None).cast("int").alias("label"))
    spread = max(1, -(-n // BLOCK))
    nearest = min(min_samples, n) - 1

    def packed(points: DataFrame, width: int) -> DataFrame:
        # as many tasks as blocks, so that blocks are full
        return cut(B.pack(points.repartition(spread, "id"), "id", "vec", width, BLOCK))

    def near(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, own: bool) -> tuple[np.ndarray, ...]:
        d = B.euclid(x, y)
        if own:
            np.fill_diagonal(d, np.inf)
        out = []
        for of, m in ((ids, d),) if own else ((ids, d), (others, d.T)):
            k = min(nearest, m.shape[1])
            out.append((np.repeat(of, k), np.partition(m, k - 1, axis=1)[:, :k].ravel()) if k else (of[:0], np.zeros(0)))
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))

    core = rows.select("id", F.lit(0.0).alias("core"))
    if nearest:
        ranked = _pairs(packed(rows, dims), near, dims, "id long, distance double").where("not isnan(distance) and distance < double('inf')")
        ranked = ranked.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("distance"))).where(F.col("n") <= nearest)
        core = ranked.where(F.col("n") == nearest).select("id", F.col("distance").alias("core"))

    def thin(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, own: bool) -> tuple[np.ndarray, ...]:
        d = np.maximum(np.maximum(B.euclid(x[:, 1:], y[:, 1:]), x[:, :1]), y[:, 0])
        if own:
            np.fill_diagonal(d, np.inf)
        i, j = (dense_forest if own else cross_forest)(d, np.finfo(float).max)
        return ids[i], others[j], d[i, j]

    reached = rows.join(core, "id").select("id", F.concat(F.array("core"), "vec").alias("vec"))
    tree = forest(cut(_pairs(packed(reached, dims + 1), thin, dims + 1, "a long, b long, weight double")))
    top = max(tree.edges.agg(F.max("weight")).first()[0], 1e-9)
    entries, clusters = hierarchy(tree.edges, rows.select(F.col("id").alias("cls"), F.lit(1).cast("long").alias("n")), tree.nodes, min_size, top, level_links, floor=1e-12)
    # the whole is no cluster
    chosen = select_stable(clusters.withColumn("preferred", F.col("preferred") & F.col("parent").isNotNull()))
    found = cut(entries.join(chosen, "cluster").where("chosen is not null").select(F.col("cls").alias("id"), F.col("chosen").alias("cluster")))
    least = found.groupBy("cluster").agg(F.min("id").alias("least"))
    labels = numbered(least, [], ["least"], "n").select("cluster", F.col("n").cast("int").alias("label"))
    return rows.select("id").join(found.join(labels, "cluster"), "id", "left").select("id", "label")
