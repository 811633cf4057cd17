"""Most similar vectors for every vector: a block matrix join.

In a tile of two blocks, vectors are coded as int8 around the tile's mean. The
product of the codes is exact in float arithmetic (its sums stay below 2^22,
else it is taken in doubles), and gives the distance of the decoded vectors;
with the two coding errors as bounds, only pairs that can lie within the radius
survive. Survivors are computed again from the doubles,
and each row's k best of the tile go on to be merged.

Defined results: vectors that are null, hold null, NaN or infinity, or have
another length than *dims* take no part; a repeated id counts once (with
several vectors, once for each); equal distances go by the smaller id; equal
vectors are at distance 0 of each other. With fewer than k others there are
fewer neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.cells import Cells, Side, blocks, classes, distances, fitted, tiles, vectors
from seqloom.session import cut

STRIP, SQUARE, THIN = 512, 2048, 1 << 20


def survivors(x: np.ndarray, y: np.ndarray, radius: float | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows whose distance may be at most *radius* (one, or one for each row of x), strip by strip of x.

    Both sides are coded as int8 around their mean, in one scale s. With codes c, d
    and coding errors e, f, a pair within the radius has
    ``s^2 (|c|^2 + |d|^2 - 2 cd) <= (radius + e + f)^2``. The product comes with
    ``-|d|^2 / 2`` as one more column, so one comparison a pair is all there is.
    """
    middle = (x.sum(0) + y.sum(0)) / (len(x) + len(y))
    scale = max(np.abs(x - middle).max(initial=0), np.abs(y - middle).max(initial=0)) / 127 or 1.0
    # the sums of a product are whole or half numbers, exact in single precision up to 2^22
    exact = np.float32 if x.shape[1] * 127**2 < 2**22 else np.float64

    def coded(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code = np.rint((z - middle) / scale).astype(np.int8)
        error = np.linalg.norm(z - middle - code * scale, axis=1)
        return code, error, np.square(code.astype(np.int32)).sum(1)

    left, e, c2 = coded(x)
    right, f, d2 = (left, e, c2) if y is x else coded(y)
    columns = np.empty((y.shape[1] + 1, len(y)), exact)
    columns[:-1], columns[-1] = right.T, -d2 / 2
    reach = np.minimum((np.broadcast_to(np.asarray(radius, float), len(x)) + e + f.max(initial=0)) / scale, 1e15)
    least = ((c2 - reach * reach * (1 + 1e-9)) / 2 - 0.1).astype(exact)
    for at in range(0, len(x), STRIP):
        to = slice(at, at + STRIP)
        rows = np.ones((len(left[to]), x.shape[1] + 1), exact)
        rows[:, :-1] = left[to]
        i, j = np.divmod(np.flatnonzero(rows @ columns >= least[to][:, None]), len(y))
        yield i + at, j


def few(found: Iterator[tuple[np.ndarray, np.ndarray]], own: bool, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The pairs *found* (i < j only if *own*), or None as soon as they are more than *most*."""
    parts, n = [], 0
    for i, j in found:
        if own:
            i, j = i[i < j], j[i < j]
        n += len(i)
        if n > most:
            return None
        parts.append((i, j))
    i, j = (np.concatenate(z) for z in zip(*parts, strict=True))
    return i, j


def measured(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs from the doubles."""
    out = np.empty(len(i))
    for at in range(0, len(i), 65536):
        to = slice(at, at + 65536)
        diff = x[i[to]] - y[j[to]]
        out[to] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def best(src: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among their source's k nearest, ties with the k-th included."""
    order = np.lexsort((distance, src))
    s, d = src[order], distance[order]
    first = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(s)))
    kth = d[start + np.minimum(k, size) - 1] if len(s) else np.zeros(0)
    return order[d <= np.repeat(kth, size)]


def tile_pairs(left: Side, right: Side, radius: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes (a, b) of a tile at most *radius* apart, where one is at home, and their distances; both orders.

    At least each class's k nearest of the tile (and ties) are among them. The tile
    is taken in squares; where most pairs of a square survive the int8 product, all
    its distances are taken at once, and only each row's and column's k nearest are
    measured again.
    """
    same = left is right
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def thin() -> None:
        """Leaves the pairs that are among the nearest of either end, as no other can come to be."""
        a, b, d = (np.concatenate(z) for z in zip(*parts, strict=True))
        kept = np.unique(best(np.concatenate((a, b)), np.concatenate((d, d)), k) % max(len(a), 1))
        parts[:] = [(a[kept], b[kept], d[kept])]

    for at in range(0, len(left.x), SQUARE):
        x, hx, nx = left.x[at : at + SQUARE], left.home[at : at + SQUARE], left.names[at : at + SQUARE]
        for to in range(at if same else 0, len(right.x), SQUARE):
            own = same and at == to
            y, hy, ny = (x, hx, nx) if own else (right.x[to : to + SQUARE], right.home[to : to + SQUARE], right.names[to : to + SQUARE])
            found = few(survivors(x, y, radius), own, max(len(x) * len(y), 1 << 18) // 64)
            if found is None:
                d = distances(x, y)
                d[~(hx[:, None] | hy)] = np.inf
                if own:
                    np.fill_diagonal(d, np.inf)
                kth = [np.partition(d, min(k, d.shape[1 - ax]) - 1, axis=1 - ax).take([min(k, d.shape[1 - ax]) - 1], axis=1 - ax) for ax in (0, 1)]
                # the distances lose some digits, so a little more than the k-th is let through
                near = (d <= radius * (1 + 1e-6)) & ((d <= kth[0] * (1 + 1e-6) + 1e-12) | (d <= kth[1] * (1 + 1e-6) + 1e-12))
                i, j = np.nonzero(np.triu(near | near.T, 1) if own else near)
            else:
                i, j = found
            keep = hx[i] | hy[j]
            i, j = i[keep], j[keep]
            d = measured(x, y, i, j)
            near = d <= radius
            parts.append((nx[i[near]], ny[j[near]], d[near]))
            if sum(len(p[0]) for p in parts[1:]) > THIN:
                thin()
    a, b, d = (np.concatenate(z) for z in zip(*parts, strict=True))
    return np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((d, d))


def edges_within(rows: DataFrame, radius: float, k: int, dims: int, block_rows: int = 8192, *, cells: Cells | None = None) -> DataFrame:
    """Per tile, each class's k nearest classes within *radius* (``a, b, distance``), and class members (``a, id``).

    *cells* fitted for the same radius may be given, so as not to fit them again.
    """
    cells = cells or fitted(rows, radius, dims, block_rows)

    def kernel(left: Side, right: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, d = tile_pairs(left, right, radius, k)
        kept = best(a, d, k)
        return a[kept], b[kept], d[kept]

    return tiles(blocks(rows, cells, dims), kernel, "distance")


def mutual_pairs(rows: DataFrame, radius: float, k: int, dims: int) -> DataFrame:
    """``id_a < id_b, distance``: ids at most *radius* apart, each among the other's k nearest."""
    found = cut(edges_within(rows, radius, k, dims))
    # of a class, only its k + 1 smallest ids can be among anyone's k nearest
    ids = found.where("id is not null").select(F.col("a").alias("cls"), "id")
    smallest = ids.withColumn("n", F.dense_rank().over(W.partitionBy("cls").orderBy("id"))).where(F.col("n") <= k + 1).select("cls", "id").distinct()
    near = found.where("b is not null").select("a", "b", "distance")
    src, dst = smallest.select(F.col("cls").alias("a"), F.col("id").alias("id_a")), smallest.select(F.col("cls").alias("b"), F.col("id").alias("id_b"))
    other = near.join(src, "a").join(dst, "b").select("id_a", "id_b", "distance")
    copies = src.join(dst, (F.col("a") == F.col("b")) & (F.col("id_a") != F.col("id_b"))).select("id_a", "id_b", F.lit(0.0).alias("distance"))
    to = W.partitionBy("id_a").orderBy("distance", "id_b")
    ranked = cut(other.unionByName(copies).where("id_a <> id_b").groupBy("id_a", "id_b").agg(F.min("distance").alias("distance")).withColumn("n", F.row_number().over(to)).where(F.col("n") <= k).drop("n"))
    back = ranked.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))
    return ranked.where("id_a < id_b").join(back, ["id_a", "id_b"], "left_semi")


_SIDES = "cell int, block int, chunk int, query boolean, id long, ids array<long>, bound double, vec binary"


def neighbours(rows: DataFrame, queries: DataFrame, k: int, dims: int, block_rows: int = 8192, query_chunk: int = 32768) -> DataFrame:
    """``id, neighbour, distance, rank``: the k nearest of *rows* for each of *queries*, exactly.

    Two rounds: a query's own block gives an upper bound of its k-th distance; then
    it visits the blocks that can hold something nearer. Base rows lie once in their
    block (once for each chunk of queries).
    """
    cells = fitted(rows, 0.0, dims, block_rows)
    chunks = max(1, -(-queries.count() // query_chunk))
    sparse = len(cells.pivots)

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, _ = vectors(batch, dims)
            if not len(ids):
                continue
            names, row, own = classes(ids, x)
            x = x[row]
            home, _ = cells.homes(cells.distances(x))
            at = cells.place(x, home)
            block = cells.blocks(home, at, 0.0, names)[0]
            # of equal vectors, only the k + 1 smallest ids can be among anyone's k nearest
            yield _batch(np.repeat(home, chunks), np.repeat(block, chunks), np.tile(np.arange(chunks), len(x)), False, np.repeat(names, chunks), [m[: k + 1] for m in own for _ in range(chunks)], np.zeros(len(x) * chunks), [v.tobytes() for v in x for _ in range(chunks)])

    def ask(batches: Iterator[pa.RecordBatch], second: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
            kept = pa.array(np.arange(batch.num_rows))
            lookup = pa.RecordBatch.from_arrays([batch.column("vec"), kept], ["vec", "id"])
            place, x, _ = vectors(lookup, dims)
            if not len(place):
                continue
            ids, bound = batch.column("id").to_numpy()[place], bound[place]
            d = cells.distances(x)
            home, near = cells.homes(d)
            if not second:
                i, c = np.arange(len(x)), home
                b = cells.blocks(home, cells.place(x, home), 0.0, ids)[0]
            else:
                row, cell = cells.visits(d, home, near, np.minimum(bound, 1e300))
                row, cell = np.concatenate((np.arange(len(x)), np.flatnonzero(home != sparse), row)), np.concatenate((home, np.full((home != sparse).sum(), sparse), cell))
                _, low, high = cells.blocks(cell, cells.place(x[row], cell), bound[row], ids[row])
                times = high - low + 1
                i, c = np.repeat(row, times), np.repeat(cell, times)
                b = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
            yield _batch(c, b, ids[i] % chunks, True, ids[i], [np.zeros(0, np.int64)] * len(i), bound[i], [x[r].tobytes() for r in i])

    def _batch(cell, block, chunk, query, ids, own, bound, vec):  # noqa: ANN001, ANN202
        return pa.RecordBatch.from_arrays(
            [pa.array(cell, pa.int32()), pa.array(block, pa.int32()), pa.array(chunk, pa.int32()), pa.array(np.full(len(cell), query)), pa.array(ids, pa.int64()), pa.array(own, pa.list_(pa.int64())), pa.array(bound, pa.float64()), pa.array(vec, pa.binary())],
            ["cell", "block", "chunk", "query", "id", "ids", "bound", "vec"],
        )

    def search(table: pa.Table) -> pa.Table:
        query = table["query"].to_numpy(zero_copy_only=False)
        q, b = np.flatnonzero(query), np.flatnonzero(~query)
        empty = pa.table({"id": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        if not len(q) or not len(b):
            return empty
        vec = table["vec"].to_pylist()
        x = np.frombuffer(b"".join(vec[i] for i in q), float).reshape(len(q), -1)
        names = table["id"].to_numpy()
        owned: dict[int, set[int]] = {}
        for i, own in zip(b, table["ids"].take(pa.array(b)).to_pylist(), strict=True):
            owned.setdefault(names[i], set()).update(own)
        _, first = np.unique(names[b], return_index=True)
        b = b[first]
        y = np.frombuffer(b"".join(vec[i] for i in b), float).reshape(len(b), -1)
        bound = table["bound"].to_numpy()[q].copy()
        if not np.isfinite(bound).all():
            # first round: the k nearest of every eighth row bound the k nearest of all
            part = y[::8] if len(y) >= 64 * (k + 1) else y
            if len(part) > k:
                for at in range(0, len(x), STRIP):
                    near = np.partition(distances(x[at : at + STRIP], part), k, axis=1)[:, k]
                    bound[at : at + STRIP] = np.minimum(bound[at : at + STRIP], near * (1 + 1e-6) + 1e-12)
        parts = []
        for i, j in survivors(x, y, np.minimum(bound, 1e30)):
            d = measured(x, y, i, j)
            kept = best(i, d, k + 1)
            parts.append((i[kept], j[kept], d[kept]))
        i, j, d = (np.concatenate(z) for z in zip(*parts, strict=True))
        own = [sorted(owned[names[b[t]]])[: k + 1] for t in j]
        size = np.array([len(o) for o in own], np.int64)
        ids, near = np.repeat(names[q][i], size), np.concatenate([np.array(o, np.int64) for o in own]) if len(own) else np.zeros(0, np.int64)
        d = np.repeat(d, size)
        other = ids != near
        ids, near, d = ids[other], near[other], d[other]
        kept = best(ids, d, k)
        return pa.table({"id": ids[kept], "neighbour": near[kept], "distance": d[kept]})

    out = "id long, neighbour long, distance double"
    stored = rows.select("id", "vec").mapInArrow(base, _SIDES)
    to = W.partitionBy("id").orderBy("distance", "neighbour")

    def round_(asking: DataFrame, second: bool) -> DataFrame:
        spots = asking.select("id", "vec", "bound").mapInArrow(lambda it: ask(it, second), _SIDES)
        found = stored.unionByName(spots).groupBy("cell", "block", "chunk").applyInArrow(search, out)
        return found.groupBy("id", "neighbour").agg(F.min("distance").alias("distance")).withColumn("rank", F.row_number().over(to)).where(F.col("rank") <= k)

    infinite = F.lit(float("inf"))
    first = cut(round_(queries.select("id", "vec", infinite.alias("bound")), False))
    bounds = first.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("known"))
    again = queries.join(bounds, "id", "left").select("id", "vec", F.coalesce("known", infinite).alias("bound"))
    return round_(again, True)
