"""The nearest rows by a distance of vectors times the sketch distance, in tiles of blocks.

Every pair is weighed by the product before it is ranked, so no row is left out
for its vector's rank alone. Blocks are bounded by rows and by hashes; a tile
counts the common hashes of all of its pairs, and only the k best of each row
leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.blocks import Kernel
from seqloom.session import cut

ROWS, HASHES, HOT, PAIRS, WIDE = 512, 1 << 18, 256, 1 << 22, 2048
_BLOCK = "ids binary, mat binary, sizes binary, hashes binary, rows binary, label int, block long"


def common_hashes(h: np.ndarray, at: np.ndarray, n: int, g: np.ndarray, to: np.ndarray, m: int) -> np.ndarray:
    """How many hashes each of n rows shares with each of m; *h* and *g* are sorted hashes, *at* and *to* their rows."""
    u, first_h, count_h = np.unique(h, return_index=True, return_counts=True)
    v, first_g, count_g = np.unique(g, return_index=True, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    a, p, b, q = first_h[i], count_h[i], first_g[j], count_g[j]
    out = np.zeros((n, m))
    pairs = p * q
    # hashes of few pairs are counted pair by pair, those of many as products of incidence matrices
    rare = np.flatnonzero(pairs <= HOT)
    upto = np.cumsum(pairs[rare])
    for part in np.split(rare, np.searchsorted(upto, np.arange(PAIRS, upto[-1], PAIRS))) if len(rare) else []:
        times = pairs[part]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        wide = np.repeat(q[part], times)
        x, y = at[np.repeat(a[part], times) + step // wide], to[np.repeat(b[part], times) + step % wide]
        out += np.bincount(x.astype(np.int64) * m + y, minlength=n * m).reshape(n, m)
    hot = np.flatnonzero(pairs > HOT)
    for k in range(0, len(hot), WIDE):
        part = hot[k : k + WIDE]
        left, right = np.zeros((n, len(part)), np.float32), np.zeros((len(part), m), np.float32)
        for c, z in enumerate(part):
            left[at[a[z] : a[z] + p[z]], c] = 1
            right[c, to[b[z] : b[z] + q[z]]] = 1
        out += left @ right
    return out


def sketch_distances(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``distances.sketch_metrics``' sketch distance: 0 for two empty sketches, 1 for one."""
    least = np.minimum(n[:, None], m)
    return np.where(least > 0, 1 - common / np.maximum(least, 1), np.where((n[:, None] == 0) & (m == 0), 0.0, 1.0))


def pack(rows: DataFrame, dims: int) -> DataFrame:
    """*rows* (``id, vec, hashes``, hashes distinct) as blocks of at most ROWS rows and HASHES hashes, or one row of more; made where the rows lie.

    With a column ``label`` (int), a block ends where the label changes, so rows should lie in its order.
    """
    labels = "label" in rows.columns

    def block(kept: list[tuple[int, np.ndarray, np.ndarray]], label: int | None, number: int) -> pa.RecordBatch:
        ids, x, h = zip(*kept, strict=True)
        sizes = np.array([len(z) for z in h], np.int64)
        hashes, at = np.concatenate(h), np.repeat(np.arange(len(h), dtype=np.int16), sizes)
        order = np.argsort(hashes, kind="stable")
        parts = (np.array(ids, np.int64), np.stack(x), sizes, hashes[order], at[order])
        return pa.RecordBatch.from_arrays([*(pa.array([np.ascontiguousarray(z).tobytes()], pa.binary()) for z in parts), pa.array([label], pa.int32()), pa.array([number], pa.int64())], ["ids", "mat", "sizes", "hashes", "rows", "label", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept: list[tuple[int, np.ndarray, np.ndarray]] = []
        held, label, number = 0, None, TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(batch.num_rows):
                if not (batch.column("id")[i].is_valid and batch.column("vec")[i].is_valid and batch.column("hashes")[i].is_valid):
                    continue
                x = batch.column("vec")[i].values.to_numpy(zero_copy_only=False).astype(float)
                h = batch.column("hashes")[i].values.to_numpy(zero_copy_only=False)
                if len(x) != dims or np.isnan(x).any():
                    continue
                here = batch.column("label")[i].as_py() if labels else None
                if kept and (len(kept) == ROWS or held + len(h) > HASHES or here != label):
                    yield block(kept, label, number)
                    kept, held, number = [], 0, number + 1
                label = here
                kept.append((batch.column("id")[i].as_py(), x, h.astype(np.int64)))
                held += len(h)
        if kept:
            yield block(kept, label, number)

    slim = rows.select(*(["label"] if labels else []), F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.col("hashes").cast("array<long>").alias("hashes"))
    return slim.mapInArrow(run, _BLOCK)


def search(rows: DataFrame, kernel: Kernel, k: int, dims: int, digits: int | None = None) -> DataFrame:
    """``id, neighbour, distance, rank``: the k nearest of *rows* (``id, vec, hashes``) for each of them by the kernel's distance times the sketch distance; ties go by the smaller id. With *digits*, products are rounded before they are ranked."""

    def side(batch: pa.RecordBatch, i: int, s: str) -> tuple[np.ndarray, ...]:
        get = lambda c, t: np.frombuffer(batch.column(f"{c}_{s}")[i].as_py(), t)
        return get("ids", np.int64), get("mat", float).reshape(-1, dims), get("sizes", np.int64), get("hashes", np.int64), get("rows", np.int16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, n, h, at = side(batch, i, "q")
                others, y, m, g, to = side(batch, i, "b")
                d = kernel(x, y) * sketch_distances(common_hashes(h, at, len(ids), g, to, len(others)), n, m)
                d = np.round(d, digits) if digits is not None else d
                d[ids[:, None] == others] = np.inf
                most = min(k, d.shape[1])
                kth = np.partition(d, most - 1, axis=1)[:, most - 1]
                r, c = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
                # equal sketches make many equal products
                order = np.lexsort((others[c], d[r, c], r))
                r, c = r[order], c[order]
                best = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, c = r[best], c[best]
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(others[c]), pa.array(d[r, c])], ["id", "neighbour", "distance"])

    packed = cut(pack(rows, dims))
    sided = lambda s: packed.select(*(F.col(c).alias(f"{c}_{s}") for c in packed.columns))
    tiles = sided("q").crossJoin(sided("b")).mapInArrow(run, "id long, neighbour long, distance double")
    to = W.partitionBy("id").orderBy("distance", "neighbour")
    return tiles.withColumn("rank", F.row_number().over(to)).where(F.col("rank") <= k)


def within_means(rows: DataFrame) -> DataFrame:
    """``label, n, mean_distance`` of ``id, label, hashes``: the mean sketch distance over the pairs of each label; NaN for a single row. A label's tiles are spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                get = lambda c, t, i=i, batch=batch: np.frombuffer(batch.column(c)[i].as_py(), t)
                n, m = get("sizes_a", np.int64), get("sizes_b", np.int64)
                own = batch.column("block_a")[i].as_py() == batch.column("block_b")[i].as_py()
                common = common_hashes(get("hashes_a", np.int64), get("rows_a", np.int16), len(n), get("hashes_b", np.int64), get("rows_b", np.int16), len(m))
                d = sketch_distances(common, n, m)
                out.append((batch.column("label_a")[i].as_py(), float(np.triu(d, 1).sum() if own else d.sum()), len(n) if own else 0))
            label, total, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(total, pa.float64()), pa.array(n, pa.int64())], ["label", "total", "n"])

    spread = rows.where("label is not null").repartition("label", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("label")
    packed = cut(pack(spread.select("id", "label", F.array(F.lit(0.0)).alias("vec"), "hashes"), 1))
    sided = lambda s: packed.select(*(F.col(c).alias(f"{c}_{s}") for c in packed.columns if c not in ("ids", "mat")))
    tiles = sided("a").join(sided("b"), (F.col("label_a") == F.col("label_b")) & (F.col("block_a") <= F.col("block_b")))
    sums = tiles.mapInArrow(run, "label int, total double, n long").groupBy("label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2
    return sums.select("label", "n", F.when(F.col("n") > 1, F.col("total") / pairs).otherwise(float("nan")).alias("mean_distance"))
