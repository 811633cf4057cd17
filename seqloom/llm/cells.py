"""Vectors in cells: which rows can lie within a radius of which, in blocks.

Pivots are fitted on a bounded sample (at most ``SAMPLE`` vectors, chosen
by hashed id; a third of the vectors may be copies of each other, so
copies count once). A vector's cell is its nearest pivot if that is within
``reach``, else the one cell of sparse vectors. Every vector is indexed, and
nothing is dropped: two vectors within the radius meet in exactly one cell,
where at least one of them is at home, by

* ``D(x, q) <= reach + radius``, and
* ``(D(x, q)^2 - D(x, p)^2) / (2 D(p, q)) <= radius`` for x's nearest pivot p

(if y is at home in q, both follow from the triangle inequality and from q
being y's nearest pivot). A cell of many rows is cut into blocks along a unit
vector, and a row goes to the pairs of blocks whose stretches lie within the
radius of its own. The rows of every block are then counted, and a block of more
than twice ``block_rows`` is split further by class name, so no tile grows with the
data, however badly the sample stands for it. Sample and pivots grow with the
rows up to fixed bounds. The sample thus decides how much work there is, never
what the result is.

Equal vectors are one class: each batch sends a class's vector once, with the
ids it has seen, so a group of copies never travels as whole rows. Where classes come
up in several batches, ``distinct`` brings each to one row before any is placed. A class is
named by 63 bits of a hash of its vector (two classes in 10^9 share one with a
chance of 5 %, in 10^8 of 0.05 %).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import cut

SAMPLE, PIVOTS = 6144, 1024
# the least sample and number of pivots, rows per sample row and per pivot, and bytes of a shuffle partition of tiles
LEAST_SAMPLE, LEAST_PIVOTS, PER_SAMPLE, PER_PIVOT, PART_BYTES = 4096, 256, 16, 128, 64 << 20
# rows placed at once, and bytes of vectors in a batch of copies
STRIP, SEND_BYTES = 1024, 8 << 20
# rows whose classes tell how often one comes up, classes that a task knows it has sent, and steps of a short vector in 1
NAMES, SEEN, MICRO = 20_000, 1 << 20, 1e6
ROWS = "cell int, bi int, bj int, side int, home boolean, cls long, ids array<long>, vec binary"
_ROWS = ["cell", "bi", "bj", "side", "home", "cls", "ids", "vec"]


@dataclass(frozen=True)
class Cells:
    """Fitted pivots; cell ``len(pivots)`` is the sparse one.

    ``cuts[c]`` are the inner edges of cell c's stretches along ``axes[c]``; stretch b
    holds the blocks ``firsts[c][b]`` to ``firsts[c][b + 1] - 1``, one or, where it has
    too many rows, several by class name. ``parts`` is the number of shuffle partitions
    that the copies of all rows ask for.
    """

    pivots: np.ndarray
    between: np.ndarray
    reach: float
    radius: float
    axes: np.ndarray
    cuts: list[np.ndarray]
    firsts: list[np.ndarray] = field(default_factory=list)
    parts: int = 1

    def distances(self, x: np.ndarray) -> np.ndarray:
        return distances(x, self.pivots)

    def homes(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cell and nearest pivot."""
        if not len(self.pivots):
            return np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
        near = d.argmin(1)
        return np.where(d[np.arange(len(d)), near] <= self.reach, near, len(self.pivots)), near

    def visits(self, d: np.ndarray, home: np.ndarray, near: np.ndarray, radius: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the dense cells besides the home in which a neighbour within *radius* may be at home."""
        if not len(self.pivots):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        r = np.broadcast_to(np.asarray(radius, float), len(d))[:, None]
        nearest = d[np.arange(len(d)), near][:, None]
        apart = 2 * self.between[near]
        plane = d**2 - nearest**2 <= r * apart * (1 + 1e-9) + 1e-12
        ball = d <= (self.reach + r) * (1 + 1e-9)
        out = plane & ball
        inside = home < len(self.pivots)
        out[np.flatnonzero(inside), home[inside]] = False
        return np.nonzero(out)

    def place(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Each row's place along its cell's axis."""
        return np.einsum("ij,ij->i", x, self.axes[cell])

    def stretches(self, cell: np.ndarray, at: np.ndarray, radius: float | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each place's stretch of its cell, and the first and last stretch within the radius of it."""
        own, low, high = (np.zeros(len(cell), np.int64) for _ in range(3))
        r = np.broadcast_to(np.asarray(radius, float), len(cell)) * (1 + 1e-9) + 1e-12
        order = np.argsort(cell, kind="stable")
        known, start = np.unique(cell[order], return_index=True)
        for c, mine in zip(known, np.split(order, start[1:]), strict=True) if len(cell) else ():
            own[mine] = np.searchsorted(self.cuts[c], at[mine], "right")
            low[mine] = np.searchsorted(self.cuts[c], at[mine] - r[mine], "left")
            high[mine] = np.searchsorted(self.cuts[c], at[mine] + r[mine], "right")
        return own, low, high

    def blocks(self, cell: np.ndarray, at: np.ndarray, radius: float | np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's block in its cell, and the first and last block within the radius of it."""
        own, low, high = self.stretches(cell, at, radius)
        base = np.concatenate(([0], np.cumsum([len(f) for f in self.firsts])))[:-1][cell]
        flat = np.concatenate(self.firsts)
        first, end = flat[base + own], flat[base + own + 1]
        return first + names % (end - first), flat[base + low], flat[base + high + 1] - 1


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows, around the mean of *y* for the digits' sake."""
    if not len(y) or not len(x):
        return np.zeros((len(x), len(y)))
    mid = y.mean(0)
    x, y = x - mid, y - mid
    # in place, as a tile should not hold more than two such matrices
    cross = x @ y.T
    cross *= 2
    out = (x * x).sum(1)[:, None] + (y * y).sum(1)
    out -= cross
    np.maximum(out, 0, out=out)
    return np.sqrt(out, out=out)


def _cover(near: np.ndarray, most: int, least: int) -> list[np.ndarray]:
    """Greedy cover: the rows around the sample row that has most rows not yet covered, again and again."""
    left, groups = np.ones(len(near), bool), []
    counts = near.sum(1, dtype=np.int32)
    while len(groups) < most:
        k = int(counts.argmax())
        if counts[k] < least:
            break
        members = np.flatnonzero(near[k] & left)
        left[members] = False
        # near is symmetric, but for the last digits of a distance
        counts -= near[members].sum(0, dtype=np.int32)
        counts[k] = 0
        if len(members) >= least:
            groups.append(members)
    return groups


def sample_rows(n_rows: int) -> int:
    return min(SAMPLE, max(LEAST_SAMPLE, n_rows // PER_SAMPLE))


def fit(sample: np.ndarray, n_rows: int, radius: float, block_rows: int) -> Cells:
    """Pivots and reach of the least expected work on the sample; stretches by the expected rows of each cell."""
    sample = np.unique(sample, axis=0)[: sample_rows(n_rows)]
    m, dims = sample.shape
    most = min(PIVOTS, max(LEAST_PIVOTS, n_rows // PER_PIVOT))
    best = (float(m) ** 2, np.zeros((0, dims)), 0.0)
    if m > 8:
        small = (sample - sample.mean(0)).astype(np.float32)
        strips = lambda: (distances(small[at : at + 512], small) for at in range(0, m, 512))
        nearest = np.quantile(np.concatenate([np.partition(x, 5, axis=1)[:, 5] for x in strips()]), (0.1, 0.5))
        reaches = sorted({max(float(q), 1e-12) * f for q in nearest for f in (1, 1.5, 2, 3, 4, 6)})
        # 16 bits will do: the distances only choose the cells; strips are made twice, as the driver should not hold them
        unit, d = reaches[-1] / 60_000, np.empty((m, m), np.uint16)
        for at, x in zip(range(0, m, 512), strips(), strict=True):
            np.minimum(x / unit, 65_535, out=x)
            d[at : at + 512] = x
        for reach in reaches:
            groups = _cover(d <= np.uint16(reach / unit), most, 2)
            if not groups:
                continue
            pivots = np.array([sample[g].mean(0) for g in groups])
            trial = Cells(pivots, distances(pivots, pivots), reach, radius, np.zeros((0, dims)), [])
            to = trial.distances(sample)
            home, near = trial.homes(to)
            own = np.bincount(home, minlength=len(pivots) + 1).astype(float)
            guests = np.bincount(trial.visits(to, home, near, radius)[1], minlength=len(pivots) + 1)
            # pairs compared, and a copied guest's cost of as many pairs as a sample row meets in a block
            cost = (own**2 / 2 + own * guests).sum() + guests.sum() * m / 16
            if cost < best[0]:
                best = (cost, pivots, reach)
    _, pivots, reach = best
    cells = Cells(pivots, distances(pivots, pivots), reach, radius, np.zeros((0, dims)), [])
    home, _ = cells.homes(cells.distances(sample)) if m else (np.zeros(0, np.int64), None)
    axes, cuts = np.zeros((len(pivots) + 1, dims)), []
    for c in range(len(pivots) + 1):
        rows = sample[home == c]
        blocks = int(np.ceil(n_rows * len(rows) / max(m, 1) / block_rows))
        if blocks < 2 or len(rows) < 2:
            cuts.append(np.zeros(0))
            continue
        axes[c] = np.linalg.svd(rows - rows.mean(0), full_matrices=False)[2][0]
        cuts.append(np.unique(np.quantile(rows @ axes[c], np.arange(1, blocks) / blocks)))
    firsts = [np.arange(len(x) + 2) for x in cuts]
    return Cells(pivots, cells.between, reach, radius, axes, cuts, firsts)


def vectors(batch: pa.RecordBatch, dims: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and vectors of the rows whose vector is whole: no null, all finite, of *dims* values (of the first whole row's if None)."""
    col = batch.column("vec")
    size = np.diff(col.offsets.to_numpy())
    flat = col.flatten()
    whole = ~col.is_null().to_numpy(zero_copy_only=False) & (size == (dims or size.max(initial=0))) & ~batch.column("id").is_null().to_numpy(zero_copy_only=False)
    size = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, size)
    values = flat.to_numpy(zero_copy_only=False).astype(float)
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    n = dims or int(size.max(initial=0))
    rows = np.flatnonzero(whole)
    x = values[start[rows][:, None] + np.arange(n)] if len(rows) else np.zeros((0, n))
    fine = np.isfinite(x).all(1)
    return batch.column("id").to_numpy(zero_copy_only=False)[rows[fine]].astype(np.int64), x[fine] + 0.0, n


def classes(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Class names, a row of each class, and the ids of each class."""
    names = np.array([xxhash.xxh3_64_intdigest(r) >> 1 for r in np.ascontiguousarray(x)], np.int64)
    order = np.lexsort((ids, names))
    names_, first = np.unique(names[order], return_index=True)
    return names_, order[first], [np.unique(g) for g in np.split(ids[order], first[1:])] if len(names_) else []


def sample_of(rows: DataFrame, n_rows: int, dims: int | None) -> np.ndarray:
    """About ``sample_rows`` whole vectors, chosen by hashed id."""
    part = max(1, round(n_rows / sample_rows(n_rows)))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(part)) == 0).select("id", "vec").limit(2 * SAMPLE)
    table = picked.toArrow().combine_chunks()
    got = [vectors(b, dims)[1] for b in table.to_batches()]
    return np.concatenate(got) if got else np.zeros((0, dims or 1))


def fitted(rows: DataFrame, radius: float, dims: int, block_rows: int) -> Cells:
    """Cells for *rows*: pivots and stretches from its sample, blocks from a count of all rows."""
    n_rows = rows.count()
    cells = fit(sample_of(rows, n_rows, dims), n_rows, radius, block_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, _ = vectors(batch, dims)
            if len(x):
                # copies travel once a batch, and only what travels fills a block
                x = x[classes(ids, x)[1]]
                of, cell, _ = _placed(cells, x)
                own, low, high = cells.stretches(cell, cells.place(x[of], cell), radius)
                key, at = np.unique(np.stack((cell, own)), axis=1, return_inverse=True)
                at = at.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(key[0]), pa.array(key[1]), pa.array(np.bincount(at)), pa.array(np.bincount(at, high - low + 1).astype(np.int64))], ["cell", "stretch", "n", "copies"])

    # one row for each stretch, about rows / block_rows and the cells
    counted = rows.select("id", "vec").mapInArrow(count, "cell long, stretch long, n long, copies long").groupBy("cell", "stretch").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies")).collect()
    splits = [np.ones(len(x) + 1, np.int64) for x in cells.cuts]
    for r in counted:
        # stretches are cut by the sample, so some have a little more than they should
        splits[r["cell"]][r["stretch"]] = max(1, -(-r["n"] // (2 * block_rows)))
    copies = sum(r["copies"] * int(splits[r["cell"]][r["stretch"]]) for r in counted)
    return replace(cells, firsts=[np.concatenate(([0], np.cumsum(x))) for x in splits], parts=1 + copies * dims * 8 // PART_BYTES)


def _placed(cells: Cells, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, cell) of every row at home, in order, then as a guest; rows visit cells of smaller number than their own only, so two rows meet once."""
    homes, guests, visited = [], [], []
    for at in range(0, len(x), STRIP):
        d = cells.distances(x[at : at + STRIP])
        home, near = cells.homes(d)
        guest, where = cells.visits(d, home, near, cells.radius)
        keep = where < home[guest]
        homes.append(home)
        guests.append(guest[keep] + at)
        visited.append(where[keep])
    return np.concatenate((np.arange(len(x)), *guests)), np.concatenate((*homes, *visited)), len(x)


def classed(rows: DataFrame, dims: int) -> DataFrame:
    """``cls long, vec binary`` of the classes of *rows*, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, _ = vectors(batch, dims)
            if len(ids):
                names, row, _ = classes(ids, x)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([v.tobytes() for v in np.ascontiguousarray(x[row])], pa.binary())], ["cls", "vec"])

    return rows.select("id", "vec").mapInArrow(run, "cls long, vec binary")


def repeats(rows: DataFrame, dims: int) -> float:
    """In how many batches a class of *rows* comes up, from the classes of about ``NAMES`` rows by hash; decides on work only, never on a result."""
    part = max(1, rows.count() // NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, _ = vectors(batch, dims)
            names = classes(ids, x)[0] if len(ids) else ids
            yield pa.RecordBatch.from_arrays([pa.array(names[names % part == 0])], ["cls"])

    n, distinct = rows.select("id", "vec").mapInArrow(run, "cls long").agg(F.count("cls"), F.count_distinct("cls")).first()
    return n / distinct if distinct else 1.0


def shortened(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: whole numbers of millionths where every value is one to the last bit, else doubles; ``lengthened`` undoes it."""
    # beyond 2^31 a number is no int32, and any such value fails the comparison
    steps = np.rint(np.clip(x, -2000, 2000) * MICRO).astype(np.int32)
    exact = (steps / MICRO == x).all(1)
    x = np.ascontiguousarray(x)
    return [(steps[i] if exact[i] else x[i]).tobytes() for i in range(len(x))]


def lengthened(raw: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(raw), dims))
    for i, b in enumerate(raw):
        out[i] = np.frombuffer(b) if len(b) == 8 * dims else np.frombuffer(b, np.int32) / MICRO
    return out


def distinct(rows: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """``id, vec``: every class of *rows* once, by its name; and ``cls, id`` of all, each once.

    Names and ids go apart from the vectors, and a vector leaves a task once (in
    ``SEEN`` classes), in millionths where it can.
    """

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, _ = vectors(batch, dims)
            if len(ids):
                names, _, members = classes(ids, x)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, [len(m) for m in members])), pa.array(np.concatenate(members))], ["cls", "id"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, x, _ = vectors(batch, dims)
            if not len(ids):
                continue
            names, row, _ = classes(ids, x)
            fresh = np.array([n not in seen for n in names.tolist()])
            if len(seen) > SEEN:
                seen.clear()
            seen.update(names.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(names[fresh]), pa.array(shortened(x[row[fresh]]), pa.binary())], ["cls", "vec"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = lengthened(batch.column("vec").to_pylist(), dims)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dims, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), vec], ["id", "vec"])

    rows = rows.select("id", "vec")
    ids = cut(rows.mapInArrow(named, "cls long, id long").distinct())
    return cut(rows.mapInArrow(once, "cls long, vec binary").dropDuplicates(["cls"]).mapInArrow(whole, "id long, vec array<double>")), ids


def blocks(rows: DataFrame, cells: Cells, dims: int) -> DataFrame:
    """The columns of ROWS: each class of *rows* (``id long, vec array<double>``) in every pair of blocks it has to meet.

    In a pair of one block (bi = bj) all rows have side 0. A class at home in block
    bi brings its ids to the pair (bi, bi), so each id comes up exactly once.
    Rows may be classes with a core distance instead (``cls, vec, core``), which then
    goes with them; these bring no ids. The copies go out in batches of bounded size,
    however many blocks a row has to meet.
    """
    radius, most = cells.radius, max(1, SEND_BYTES // (8 * dims))
    carried = ["core"] if "core" in rows.columns else []

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if carried:
                names, core = (batch.column(c).to_numpy() for c in ("cls", "core"))
                x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), float).reshape(len(names), dims)
                members = [np.zeros(0, np.int64)] * len(names)
            else:
                ids, x, _ = vectors(batch, dims)
                names, row, members = classes(ids, x)
                x = x[row]
            if not len(names):
                continue
            of, cell, at_home = _placed(cells, x)
            is_home = np.arange(len(of)) < at_home
            block, low, high = cells.blocks(cell, cells.place(x[of], cell), radius, names[of])
            times = high - low + 1
            ends = np.cumsum(times)
            vec = np.ascontiguousarray(x)
            raw = [vec[i].tobytes() for i in range(len(vec))]
            none = np.zeros(0, np.int64)
            for at in range(0, int(ends[-1]), most):
                copy = np.arange(at, min(at + most, int(ends[-1])))
                k = np.searchsorted(ends, copy, "right")
                other = copy - (ends - times)[k] + low[k]
                bi, bj, side = np.minimum(block[k], other), np.maximum(block[k], other), (other < block[k]).astype(np.int64)
                # a class brings its ids to one table of tiles only
                ids_of = [members[of[i]] if is_home[i] and a == b else none for i, a, b in zip(k, bi, bj, strict=True)]
                out = [
                    pa.array(cell[k], pa.int32()), pa.array(bi, pa.int32()), pa.array(bj, pa.int32()), pa.array(side, pa.int32()), pa.array(is_home[k]),
                    pa.array(names[of[k]]), pa.array(ids_of, pa.list_(pa.int64())), pa.array([raw[i] for i in of[k]], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(core[of[k]])] if carried else [])], [*_ROWS, *carried])

    placed = rows.select(*(("cls", "vec", "core") if carried else ("id", "vec"))).mapInArrow(assign, ROWS + (", core double" if carried else ""))
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(cells.parts, "cell", "bi", "bj") if cells.parts > usual else placed


@dataclass
class Side:
    """The distinct classes of one side of a pair of blocks."""

    names: np.ndarray
    home: np.ndarray
    x: np.ndarray
    core: np.ndarray


class _Arriving:
    """A side whose rows come in batch by batch; each class is held once, and no batch is kept."""

    def __init__(self) -> None:
        self.seen: set[int] = set()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.x = np.zeros((0, 1))

    def add(self, batch: pa.RecordBatch, rows: np.ndarray) -> None:
        names = batch.column("cls").to_numpy()[rows]
        _, first = np.unique(names, return_index=True)
        fresh = np.array([i for i in first if names[i] not in self.seen], np.int64)
        if not len(fresh):
            return
        names, rows = names[fresh], rows[fresh]
        self.seen.update(names.tolist())
        core = batch.column("core").to_numpy()[rows] if "core" in batch.schema.names else np.zeros(len(rows))
        self.parts.append((names, batch.column("home").to_numpy(zero_copy_only=False)[rows], core))
        new = np.frombuffer(b"".join(batch.column("vec").take(pa.array(rows)).to_pylist()), float).reshape(len(rows), -1)
        held = len(self.x)
        # grown in place, so that the rows are never held twice
        self.x.resize((held + len(new), new.shape[1]), refcheck=False)
        self.x[held:] = new

    def side(self) -> Side:
        names, home, core = (np.concatenate(z) for z in zip((np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)), *self.parts, strict=True))
        return Side(names, home, self.x, core)


def members(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(class, id) of the ids that a batch of a pair of blocks brings."""
    ids = batch.column("ids")
    return np.repeat(batch.column("cls").to_numpy(), np.diff(ids.offsets.to_numpy())), ids.flatten().to_numpy()


def tiles(placed: DataFrame, kernel: Callable[[Side, Side], tuple[np.ndarray, np.ndarray, np.ndarray]], value: str) -> DataFrame:
    """``a, b``, *value*, ``id``: per pair of blocks what *kernel* finds between its sides (the same object twice for a pair of one block), and the class members ``a, id``.

    Members go on as they come, so a class of very many ids fills no task; an id
    that came up in several batches is there several times.
    """

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arriving = _Arriving(), _Arriving()
        for batch in batches:
            cls, ids = members(batch)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.nulls(len(ids), pa.int64()), pa.array(np.zeros(len(ids))), pa.array(ids)], ["a", "b", value, "id"])
            side = batch.column("side").to_numpy()
            for s, rows in enumerate(arriving):
                rows.add(batch, np.flatnonzero(side == s))
        left = arriving[0].side()
        a, b, w = kernel(left, left if key[1] == key[2] else arriving[1].side())
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(w), pa.nulls(len(a), pa.int64())], ["a", "b", value, "id"])

    return placed.groupBy("cell", "bi", "bj").applyInArrow(run, f"a long, b long, {value} double, id long")
