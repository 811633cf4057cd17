"""Distances of a stated query set against all rows, and sums of distances, in matrix blocks.

Rows are packed into blocks of bounded size where they lie (no shuffle); a
kernel turns two blocks into a tile of distances in numpy, of which only the k
best of each query, or sums per label, leave the task. No pair becomes a row
unless it is a result.

Kernels: ``euclid``, ``proportional`` (of k-mer profiles) and ``coverage`` (of
interleaved means and variances). Vectors that are null, of another length than
*dims* or hold null or NaN take no part; ids are taken as they are, and a
repeated id counts as often as it stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import distances as D
from seqloom.session import cut

BLOCK, QUERY_BLOCK = 2048, 512
_BLOCK = "block long, label int, ids binary, labels binary, mat binary"
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def euclid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, from differences where two vectors are nearly equal."""
    mid = y.mean(0)
    a, b = x - mid, y - mid
    na, nb = (a * a).sum(1), (b * b).sum(1)
    square = np.maximum(na[:, None] + nb - 2 * (a @ b.T), 0)
    i, j = np.nonzero(square <= 1e-6 * (na[:, None] + nb))
    square[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return np.sqrt(square)


def proportional(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(1 - rho) / 2 as ``distances.proportionality``."""
    a, b = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    dot = a @ b.T
    both = (a * a).sum(1)[:, None] + (b * b).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        rho = 0.5 - dot / both
    return np.where(both == 0, 0.0, np.where((dot == 0) | np.isnan(rho), 1.0, rho))


def _horner(a: np.ndarray, terms: tuple[float, ...]) -> np.ndarray:
    out = np.full_like(a, terms[0])
    for t in terms[1:]:
        out = out * a + t
    return out


def normal_cdf(x: np.ndarray) -> np.ndarray:
    a = np.minimum(np.abs(x), D.TAIL_FAR + 1)
    e = np.exp(-a * a / 2)
    far = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    tail = np.where(a > D.TAIL_FAR, 0.0, np.where(a < D.TAIL_NEAR, e * _horner(a, D.TAIL_TOP) / _horner(a, D.TAIL_BOTTOM), e / far / D.ROOT_TWO_PI))
    return np.where(x > 0, 1 - tail, tail)


def areas(ma: np.ndarray, va: np.ndarray, mb: np.ndarray, vb: np.ndarray, strict: bool) -> np.ndarray:
    """``distances.with_overlap_area`` of arrays, NaN where a sample tells nothing and minus infinity for a negative area."""
    ma, mb = ma + D.SHIFT, mb + D.SHIFT
    va, vb = np.maximum(va + D.SHIFT, D.LEAST_VARIANCE), np.maximum(vb + D.SHIFT, D.LEAST_VARIANCE)
    gap = va - vb
    same = np.abs(gap) < D.SAME_VARIANCE
    safe = np.where(same, 1.0, gap)
    with np.errstate(invalid="ignore"):
        root = np.sqrt(va * vb * ((ma - mb) ** 2 - 2 * gap * np.log(np.sqrt(vb / va))))
    middle = (ma + mb) / 2
    k1, k2 = np.where(same, middle, (root - ma * vb + mb * va) / safe), np.where(same, middle, (root + ma * vb - mb * va) / -safe)
    low, high = np.minimum(k1, k2), np.maximum(k1, k2)
    swap = va > vb
    m1, s1, m2, s2 = np.where(swap, mb, ma), np.sqrt(np.where(swap, vb, va)), np.where(swap, ma, mb), np.sqrt(np.where(swap, va, vb))
    f1, f2 = normal_cdf((low - m1) / s1), normal_cdf((low - m2) / s2)
    single = f1 - f2
    wide = np.abs(normal_cdf((high - m1) / s1) - f1 + f2 - normal_cdf((high - m2) / s2))
    area = np.where(np.abs(low - high) < D.SHIFT, single if strict else np.abs(single), wide)
    present = (ma > D.SHIFT) | (mb > D.SHIFT)
    if strict:
        return np.where(present & (ma != mb), np.where(area < 0, -np.inf, area), np.nan)
    return np.where(present, np.maximum(np.where((ma == mb) & same, 0.0, area), D.FLOOR), np.nan)


# the normal distribution function less a half, and its density, at every 1 / NODES up to FAR
NODES, FAR = 1024, 9
_AT = np.arange(-FAR * NODES, FAR * NODES + 1) / NODES
_HALVES, _DENSITY = normal_cdf(_AT) - 0.5, np.exp(-_AT * _AT / 2) / D.ROOT_TWO_PI
# pairs of a sample taken at once, and samples whose areas are multiplied before a logarithm (FLOOR^30 is no underflow)
STRIP, TOGETHER = 1 << 16, 30


def _halves(z: np.ndarray, at: np.ndarray, index: np.ndarray, work: tuple[np.ndarray, ...]) -> np.ndarray:
    """``normal_cdf(z) - 0.5`` to 1e-15: the nearest node's series up to the third power, in the arrays of *work*; *z* is lost."""
    near, there, slope = work
    np.minimum(z, FAR, out=z)
    np.maximum(z, -FAR, out=z)
    np.multiply(z, NODES, out=near)
    np.rint(near, out=near)
    np.add(near, FAR * NODES, out=at)
    index[...] = at
    near *= 1 / NODES
    z -= near
    np.take(_HALVES, index, out=there, mode="clip")
    np.take(_DENSITY, index, out=slope, mode="clip")
    # there + slope * z * (1 - near * z / 2 + ((near * z)^2 - z^2) / 6)
    slope *= z
    np.multiply(near, z, out=at)
    np.multiply(at, at, out=near)
    z *= z
    near -= z
    near *= 1 / 6
    at *= 0.5
    near -= at
    near += 1
    near *= slope
    near += there
    return near


def coverage(x: np.ndarray, y: np.ndarray, strict: bool = False) -> np.ndarray:
    """Geometric means of the samples' areas; vectors hold mean and variance in turn.

    The densities of a pair cross where ``(root * s -+ gap of means * s') / gap of variances``
    deviations lie from either mean, so square roots and logarithms of the variances are
    taken once a row. Pairs of nearly equal variances are left to ``areas``.
    """
    if strict:
        return coverage_strict(x, y)
    ma, mb = x[:, 0::2] + D.SHIFT, np.ascontiguousarray(y[:, 0::2].T) + D.SHIFT
    va, vb = np.maximum(x[:, 1::2] + D.SHIFT, D.LEAST_VARIANCE), np.maximum(np.ascontiguousarray(y[:, 1::2].T) + D.SHIFT, D.LEAST_VARIANCE)
    sa, sb, la, lb = np.sqrt(va), np.sqrt(vb), np.log(va), np.log(vb)
    out, samples = np.ones((len(x), len(y))), ma.shape[1]
    if not out.size:
        return out
    step = max(1, STRIP // len(y))
    held = np.empty((9, min(step, len(x)), len(y)))
    numbers = np.empty(held.shape[1:], np.intp)
    for at in range(0, len(x), step):
        r = slice(at, min(at + step, len(x)))
        gap, means, root, z, w, product, area, *work = held[:, : r.stop - at]
        work, index = (w, *work), numbers[: r.stop - at]
        logs, told = out[r], np.zeros((r.stop - at, len(y)), np.int32)
        logs[...] = 0
        product.fill(1)
        for s in range(samples):
            left, right = sa[r, s, None], sb[s]
            np.subtract(va[r, s, None], vb[s], out=gap)
            np.subtract(ma[r, s, None], mb[s], out=means)
            np.subtract(la[r, s, None], lb[s], out=root)
            root *= gap
            np.multiply(means, means, out=z)
            root += z
            np.sqrt(root, out=root)
            np.abs(gap, out=w)
            close = w < D.SAME_VARIANCE
            # crossings that are one
            np.multiply(root, left, out=z)
            z *= 2 * right
            w *= D.SHIFT
            close |= z < w
            np.copyto(gap, 1, where=close)
            means /= gap
            root /= gap
            area.fill(0)
            for narrow, wide, add in ((left, right, np.add), (right, left, np.subtract)):
                for turn in (np.subtract, np.add):
                    np.multiply(root, wide, out=z)
                    np.multiply(means, narrow, out=w)
                    turn(z, w, out=z)
                    add(area, _halves(z, gap, index, work), out=area)
            np.abs(area, out=area)
            np.maximum(area, D.FLOOR, out=area)
            i, j = np.nonzero(close)
            if len(i):
                area[i, j] = areas(x[i + at, 2 * s], x[i + at, 2 * s + 1], y[j, 2 * s], y[j, 2 * s + 1], False)
            present = (ma[r, s, None] > D.SHIFT) | (mb[s] > D.SHIFT)
            np.copyto(area, 1, where=~present)
            told += present
            product *= area
            if s % TOGETHER == TOGETHER - 1 or s == samples - 1:
                logs += np.log(product)
                product.fill(1)
        # without a told sample the mean is that of an area of 1
        logs /= np.maximum(told, 1)
        np.exp(logs, out=logs)
    return out


def coverage_strict(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``coverage`` with the sign and the skipped samples of the plain formula."""
    out = np.empty((len(x), len(y)))
    for i, row in enumerate(x):
        area = areas(row[0::2], row[1::2], y[:, 0::2], y[:, 1::2], True)
        told = ~np.isnan(area)
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(area == -np.inf, np.nan, np.log(np.where(told & (area >= 0), area, 1.0)))
            mean = np.exp(np.where(told, logs, 0).sum(1) / told.sum(1))
        out[i] = np.where(np.isnan(mean), 1.0, mean)
    return out


def pack(rows: DataFrame, id_: str, vec: str, dims: int, size: int = BLOCK, label: str | None = None, by_label: bool = False) -> DataFrame:
    """*rows* as matrix blocks of at most *size* rows, made where the rows lie. With *by_label* a block holds one label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal number
            groups = [np.flatnonzero(labels == v) for v in np.unique(labels)] if by_label else [np.arange(len(ids))]
            for g in groups:
                for at in range(0, len(g), size):
                    r = g[at : at + size]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), pa.array([int(labels[r[0]]) if by_label else 0], pa.int32()), *(pa.array([np.ascontiguousarray(z[r]).tobytes()], pa.binary()) for z in (ids, labels, x))],
                        ["block", "label", "ids", "labels", "mat"],
                    )
                    number += 1

        for batch in batches:
            col = batch.column("vec")
            n = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, np.diff(col.offsets.to_numpy()))
            values = col.flatten().to_numpy(zero_copy_only=False).astype(float)
            start = np.cumsum(n) - n
            whole = np.flatnonzero((n == dims) & ~batch.column("id").is_null().to_numpy(zero_copy_only=False))
            x = values[start[whole][:, None] + np.arange(dims)] if len(whole) else np.zeros((0, dims))
            fine = ~np.isnan(x).any(1)
            whole, x = whole[fine], x[fine]
            kept.append((batch.column("id").to_numpy(zero_copy_only=False)[whole].astype(np.int64), batch.column("lab").fill_null(-1).to_numpy(zero_copy_only=False)[whole].astype(np.int64), x))
            if sum(len(k[0]) for k in kept) >= 8 * size:
                yield from flush(*(np.concatenate(z) for z in zip(*kept, strict=True)))
                kept = []
        if kept and sum(len(k[0]) for k in kept):
            yield from flush(*(np.concatenate(z) for z in zip(*kept, strict=True)))

    lab = F.col(label).cast("int") if label else F.lit(0)
    slim = rows.select(F.col(id_).cast("long").alias("id"), lab.alias("lab"), F.col(vec).cast("array<double>").alias("vec"))
    return slim.mapInArrow(run, _BLOCK)


def _unpack(batch: pa.RecordBatch, i: int, side: str, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c, t: np.frombuffer(batch.column(f"{c}_{side}")[i].as_py(), t)
    return get("ids", np.int64), get("labels", np.int64), get("mat", float).reshape(-1, dims)


def _sided(blocks: DataFrame, side: str) -> DataFrame:
    return blocks.select(*(F.col(c).alias(f"{c}_{side}") for c in blocks.columns))


def search(queries: DataFrame, base: DataFrame, kernel: Kernel, k: int, dims: int, digits: int | None = None) -> DataFrame:
    """``id, neighbour, distance, rank``: the k nearest of the packed *base* for each of the packed *queries*, itself left out.

    With *digits*, distances are rounded before they are ranked; ties go by the smaller id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, _, x = _unpack(batch, i, "q", dims)
                others, _, y = _unpack(batch, i, "b", dims)
                d = kernel(x, y)
                d = np.round(d, digits) if digits is not None else d
                d[ids[:, None] == others] = np.inf
                most = min(k, d.shape[1])
                kth = np.partition(d, most - 1, axis=1)[:, most - 1]
                r, c = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(others[c]), pa.array(d[r, c])], ["id", "neighbour", "distance"])

    # one row per pair of blocks; the blocks of one query set are spread over all tasks
    tiles = _sided(queries, "q").crossJoin(_sided(base, "b")).mapInArrow(run, "id long, neighbour long, distance double")
    to = W.partitionBy("id").orderBy("distance", "neighbour")
    return tiles.withColumn("rank", F.row_number().over(to)).where(F.col("rank") <= k)


def label_sums(blocks: DataFrame, kernel: Kernel, dims: int) -> DataFrame:
    """``id, label, other_label, total, n``: each row's distances to all other rows, summed per label in the tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, x = _unpack(batch, i, "a", dims)
                others, theirs, y = _unpack(batch, i, "b", dims)
                d = kernel(x, y)
                same = ids[:, None] == others
                d[same] = 0
                known, at = np.unique(theirs, return_inverse=True)
                hot = np.zeros((len(others), len(known)))
                hot[np.arange(len(others)), at] = 1
                total, n = d @ hot, (~same).astype(float) @ hot
                r, c = np.nonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[r]), pa.array(labels[r], pa.int32()), pa.array(known[c], pa.int32()), pa.array(total[r, c]), pa.array(n[r, c].astype(np.int64))], ["id", "label", "other_label", "total", "n"]
                )

    tiles = _sided(blocks, "a").crossJoin(_sided(blocks, "b"))
    sums = tiles.mapInArrow(run, "id long, label int, other_label int, total double, n long")
    return sums.groupBy("id", "label", "other_label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def pair_sums(rows: DataFrame, kernel: Kernel, dims: int, size: int = BLOCK, spread: int = 12) -> DataFrame:
    """``label, other_label, total, n``: distances between the rows (``label, vec``) of different labels, for a symmetric *kernel*.

    Nothing is told of single rows, so equal vectors are measured once and counted as
    often as they stand, each pair of blocks is measured from one side, and blocks of
    one and the same label do not meet. Rows count as different, whatever they hold.
    """
    held = rows.where("label is not null and vec is not null").groupBy("vec", "label").agg(F.count(F.lit(1)).alias("n"))
    classes = held.groupBy("vec").agg(F.collect_list(F.struct("label", "n")).alias("in"))
    # classes of a single label lie together, by that label; those of several apart
    only = F.when(F.size("in") == 1, F.col("in")[0]["label"])
    classes = classes.select(only.alias("only"), F.col("in.label").alias("labels"), F.col("in.n").alias("counts"), "vec")

    def pack_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kept: list[tuple[int, list[int], list[int], np.ndarray]] = []

        def block() -> pa.RecordBatch:
            known, at = np.unique(np.concatenate([k[1] for k in kept]), return_inverse=True)
            weights = np.zeros((len(kept), len(known)))
            weights[np.repeat(np.arange(len(kept)), [len(k[1]) for k in kept]), at] = np.concatenate([k[2] for k in kept])
            parts = (known.astype(np.int64), weights, np.stack([k[3] for k in kept]))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([kept[0][0]], pa.int32()), *(pa.array([z.tobytes()], pa.binary()) for z in parts)], ["block", "only", "labels", "weights", "mat"])

        for batch in batches:
            for row in batch.to_pylist():
                x = np.array(row["vec"], float)
                if len(x) != dims or np.isnan(x).any():
                    continue
                if kept and (len(kept) == size or row["only"] != kept[0][0]):
                    yield block()
                    kept, number = [], number + 1
                kept.append((row["only"], row["labels"], row["counts"], x))
        if kept:
            yield block()

    packed = cut(classes.repartition("only").sortWithinPartitions("only").mapInArrow(pack_classes, "block long, only int, labels binary, weights binary, mat binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, t, i=i, batch=batch: np.frombuffer(batch.column(c)[i].as_py(), t)
                a, b = get("labels_a", np.int64), get("labels_b", np.int64)
                w, v = get("weights_a", float).reshape(-1, len(a)), get("weights_b", float).reshape(-1, len(b))
                total = w.T @ kernel(get("mat_a", float).reshape(-1, dims), get("mat_b", float).reshape(-1, dims)) @ v
                n = np.outer(w.sum(0), v.sum(0)).astype(np.int64)
                if batch.column("block_a")[i].as_py() != batch.column("block_b")[i].as_py():
                    a, b, total, n = (np.concatenate(z) for z in ((np.repeat(a, len(b)), np.tile(b, len(a))), (np.tile(b, len(a)), np.repeat(a, len(b))), (total.ravel(), total.ravel()), (n.ravel(), n.ravel())))
                else:
                    a, b, total, n = np.repeat(a, len(b)), np.tile(b, len(a)), total.ravel(), n.ravel()
                k = np.flatnonzero(a != b)
                yield pa.RecordBatch.from_arrays([pa.array(a[k], pa.int32()), pa.array(b[k], pa.int32()), pa.array(total[k]), pa.array(n[k])], ["label", "other_label", "total", "n"])

    # every task has some blocks of either side; which side a pair is measured from is drawn, so that all have about as much
    parts = max(1, min(spread, packed.count()))
    a, b = (_sided(packed.repartition(parts, "block"), s) for s in "ab")
    drawn = F.pmod(F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b")), F.lit(2)) == 0
    once = (F.col("block_a") == F.col("block_b")) & F.col("only_a").isNull() | (F.col("block_a") != F.col("block_b")) & (drawn == (F.col("block_a") < F.col("block_b")))
    # null only where both are null, which have to meet
    apart = F.coalesce(F.col("only_a") != F.col("only_b"), F.lit(True))
    tiles = a.hint("shuffle_replicate_nl").join(b, once & apart)
    sums = tiles.mapInArrow(run, "label int, other_label int, total double, n long")
    return sums.groupBy("label", "other_label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def within_means(blocks: DataFrame, kernel: Kernel, dims: int) -> DataFrame:
    """``label, n, mean_distance``: mean over the pairs of each label's rows (blocks packed *by_label*); NaN for a single row. A label's tiles are spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                _, labels, x = _unpack(batch, i, "a", dims)
                _, _, y = _unpack(batch, i, "b", dims)
                own = batch.column("block_a")[i].as_py() == batch.column("block_b")[i].as_py()
                d = kernel(x, y)
                out.append((int(labels[0]), float(np.triu(d, 1).sum() if own else d.sum()), len(x) if own else 0))
            label, total, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(total, pa.float64()), pa.array(n, pa.int64())], ["label", "total", "n"])

    a, b = _sided(blocks, "a"), _sided(blocks, "b")
    tiles = a.join(b, (F.col("label_a") == F.col("label_b")) & (F.col("block_a") <= F.col("block_b")))
    sums = tiles.mapInArrow(run, "label int, total double, n long").groupBy("label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2
    return sums.select("label", "n", F.when(F.col("n") > 1, F.col("total") / pairs).otherwise(float("nan")).alias("mean_distance"))


def linkage(sums: DataFrame) -> DataFrame:
    """``label, other_label, mean_distance`` of different labels: the mean over all pairs (average linkage)."""
    kept = sums.where("label <> other_label").groupBy("label", "other_label").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    return kept.select("label", "other_label", (F.col("t") / F.col("n")).alias("mean_distance"))


def silhouettes(sums: DataFrame) -> DataFrame:
    """``id, label, silhouette``: (b - a) / max(a, b), with a and b the mean distances to the own and the nearest other label.

    Outliers (label -1) and rows alone in their label, or without another label, have 0.
    """
    clean = sums.where("other_label <> -1")
    mean = F.col("total") / F.col("n")
    parts = clean.groupBy("id", "label").agg(F.max(F.when(F.col("label") == F.col("other_label"), mean)).alias("a"), F.min(F.when(F.col("label") != F.col("other_label"), mean)).alias("b"))
    value = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return parts.select("id", "label", F.when(F.col("label") == -1, 0.0).otherwise(F.coalesce(value, F.lit(0.0))).alias("silhouette"))
