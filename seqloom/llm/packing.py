"""Filling fixed-capacity containers with items.

Sizes are whole numbers up to the capacity, so the instance is its histogram:
at most ``capacity`` counts, whatever the number of items. On the histogram,
Martello and Toth's dominance reduction fixes sets of one to three sizes that
provably belong to some best solution, as often as the counts allow at once;
the sizes that are left are packed best-fit, each into the fullest container that
takes it. The
result is a list of patterns with multiplicities. Items get a rank within their
size (distributed, see ``operators.ranks``) and find their container by rank.

Items above the capacity, and only those, are split: into full containers and
a remainder that is packed as an item.

Defined results: a null or negative size is 0; an item of size 0 takes no room
and has a null container; repeated items are packed each; ties go by id.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ranks import running_sum
from seqloom.session import cut


@dataclass
class Histogram:
    """Counts by size, with the sizes in use kept sorted."""

    count: dict[int, int]
    sizes: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.count = {s: n for s, n in self.count.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, sizes: tuple[int, ...], times: int) -> None:
        for s in sizes:
            self.count[s] -= times
            if not self.count[s]:
                del self.count[s]
                self.sizes.remove(s)

    def times(self, sizes: tuple[int, ...]) -> int:
        """How often the set can be taken."""
        return min(self.count.get(s, 0) // sizes.count(s) for s in set(sizes))

    def largest(self, room: int, *used: int) -> int:
        """The largest size that fits in *room* when *used* are taken, 0 if none."""
        k = bisect_right(self.sizes, room)
        while k:
            k -= 1
            s = self.sizes[k]
            if self.count[s] > used.count(s):
                return s
        return 0

    def smallest(self, n: int, used: int) -> list[int]:
        """The *n* smallest items besides one of size *used*."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.count[s] - (s == used))
            if len(out) == n:
                break
        return out


def dominating(h: Histogram, item: int, capacity: int) -> tuple[int, ...] | None:
    """A set with *item* that dominates every other feasible set with it, by Martello and Toth's criterion for up to three items."""
    room = capacity - item
    best = h.largest(room, item)
    if not best:
        return (item,)
    if best == room:
        return (item, best)
    low = h.smallest(3, item)
    if len(low) < 2 or low[0] + low[1] > room:
        return (item, best)
    # sets of three: the fullest pair of further items, and the largest that can be the smaller one of a pair
    half, top = h.largest(room // 2, item), 0
    for s in h.sizes[: bisect_right(h.sizes, room)]:
        if h.count[s] > (s == item):
            other = h.largest(room - s, item, s)
            top = max(top, s + other if other else 0)
    if len(low) > 2 and sum(low) <= room:
        return None
    if best >= top:
        return (item, best)
    second = h.largest(room - best, item, best)
    if second and second >= half:
        return (item, best, second)
    return None


def reduce(h: Histogram, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets until none is found; the histogram keeps the rest."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    found = True
    while found:
        found = False
        for item in sorted(h.count, reverse=True):
            if item * 2 <= capacity and (low := h.smallest(3, item)) and len(low) > 2 and sum(low) <= capacity - item and capacity - item not in h.count:
                break  # four fit with this and with every smaller item: no criterion applies to them
            while item in h.count and (sets := dominating(h, item, capacity)):
                times = h.times(sets)
                h.take(sets, times)
                fixed.append((sets, times))
                found = True
    return fixed


def best_fit(h: Histogram, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs the histogram best-fit: items by falling size, each into the fullest container that takes it, else into a new one.

    Containers of one filling are one group, and a size is placed a group at a time,
    so the work depends on the sizes, not on the items. A size splits at most one
    group, so groups are few.
    """
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room: filling and how many containers
    rooms: list[int] = []  # in use, sorted

    def put(room: int, sets: tuple[int, ...], times: int) -> None:
        if times:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((sets, times))

    for s in reversed(h.sizes):
        left = h.count[s]
        while left:
            k = bisect_left(rooms, s)
            if k < len(rooms):
                room = rooms[k]
                sets, times = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                room, sets, times = capacity, (), left
            # a container stays the fullest that takes the size until it takes no more of it
            each = room // s
            whole = min(times, left // each)
            rest = left - whole * each if whole < times else 0
            put(room - each * s, (*sets, *[s] * each), whole)
            if rest:
                put(room - rest * s, (*sets, *[s] * rest), 1)
            if sets:
                put(room, sets, times - whole - bool(rest))
            left -= whole * each + rest
    h.count, h.sizes = {}, []
    return [g for room in rooms for g in groups[room]]


def solve(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and multiplicities that pack the histogram."""
    h = Histogram(dict(counts))
    return reduce(h, capacity) + best_fit(h, capacity)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``size, first rank, rank after the last, first container, items of the size per container``."""
    at: dict[int, int] = {}
    out, container = [], 0
    for sets, times in patterns:
        for s in sorted(set(sets)):
            n, first = sets.count(s), at.get(s, 0)
            out.append((s, first, first + n * times, container, n))
            at[s] = first + n * times
        container += times
    return out


def pieces(items: DataFrame, item_id: str, size: str, capacity: int) -> DataFrame:
    """``item_id, piece_no, n_tokens``: one row per item, or per part of an item above the capacity."""
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    parts = items.select(F.col(item_id).alias("item_id"), n.alias("n")).withColumn("last", F.greatest(F.floor((F.col("n") - 1) / F.lit(capacity)), F.lit(0).cast("long")))
    each = parts.select("item_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("piece_no"))
    return each.select("item_id", "piece_no", F.least(F.col("n") - F.col("piece_no") * capacity, F.lit(capacity).cast("long")).alias("n_tokens"))


def pack(items: DataFrame, item_id: str, size: str, capacity: int = 2048, bucket_rows: int = 1 << 18) -> DataFrame:
    """``item_id, piece_no, n_tokens, container_id`` for every item of *items*.

    Items are ranked within their size in buckets of about *bucket_rows* by hashed id, as many as the commonest size asks for.
    """
    rows = cut(pieces(items, item_id, size, capacity))
    counts = {r["n_tokens"]: r["n"] for r in rows.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = slots(solve(counts, capacity))
    # one row per size, at most `capacity` rows: its rank ranges as sorted arrays
    by_size: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for row in table:
        by_size.setdefault(row[0], []).append(row)
    spark = items.sparkSession
    where = spark.createDataFrame(
        [(s, [r[1] for r in rs], [r[3] for r in rs], [r[4] for r in rs]) for s, rs in by_size.items()],
        "size long, firsts array<long>, containers array<long>, times array<long>",
    )
    buckets = max(1, -(-max(counts.values(), default=0) // bucket_rows))
    bucket = F.pmod(F.xxhash64("item_id", "piece_no"), F.lit(buckets))
    ranked = running_sum(rows.where("n_tokens > 0"), ["n_tokens"], bucket, ["item_id", "piece_no"], F.lit(1).cast("long"), "rank")
    placed = ranked.join(F.broadcast(where), F.col("n_tokens") == F.col("size")).mapInArrow(_place, "item_id long, piece_no long, n_tokens long, container_id long")
    empty = rows.where("n_tokens = 0").select("item_id", "piece_no", "n_tokens", F.lit(None).cast("long").alias("container_id"))
    return placed.unionByName(empty)


def _place(batches):  # noqa: ANN001, ANN202
    """Finds each rank's container in its size's ranges."""
    import pyarrow as pa

    for batch in batches:
        get = {c: batch.column(c) for c in ("rank", "firsts", "containers", "times")}
        rank = get["rank"].to_numpy()
        out = np.zeros(len(rank), np.int64)
        if len(rank):
            edges = get["firsts"].offsets.to_numpy()
            firsts, containers, times = (get[c].values.to_numpy() for c in ("firsts", "containers", "times"))
            # ranks and ranges of all rows on one line: each row's ranges lie behind those of the rows before
            span = int(max(rank.max(), firsts.max() if len(firsts) else 0)) + 1
            row = np.repeat(np.arange(len(rank)), np.diff(edges))
            at = np.searchsorted(row * span + firsts[edges[0] : edges[-1]], np.arange(len(rank)) * span + rank, "right") - 1 + edges[0]
            out = containers[at] + (rank - firsts[at]) // times[at]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("piece_no"), batch.column("n_tokens"), pa.array(out)], ["item_id", "piece_no", "n_tokens", "container_id"])


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers used, the least possible number, and the share of room filled."""
    used = packed.where("container_id is not null").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return used.select(
        "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.lit(capacity)).alias("least_containers"),
        F.try_divide(F.col("n_tokens").cast("double"), F.col("n_containers") * F.lit(float(capacity))).alias("fill"),
    )
