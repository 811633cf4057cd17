"""Overlap sizes between many large sets, maintained by signed pair deltas.

The state holds pair counts, never intersections. When identifiers join or
leave sets, each changed identifier is met with its other memberships (in
buckets of identifiers), and every pair of sets it is in, or was in, gets +1 or
-1; a bucket adds up its deltas before they travel. A batch reads the members of
the buckets that it changes, and of no other; its deltas are kept beside those of
the batches before, and added up when counts are asked for or after ``compacted``.
Buckets are split anew as the members double, so a bucket stays within a task.
Loading from nothing is one batch of joins.

An identifier in more than ``RARE`` sets would give pairs without end. Its
memberships are kept as incidence rows instead, and an identifier that crosses
the line takes its pair counts back. What such common identifiers add to a pair
is counted only for pairs that can still reach the asked overlap; pairs that
share nothing but common identifiers can reach it only if these make up that
share of the smaller set, and such sets are met with all others in blocks of an
incidence product. So every pair at or above the overlap is found, with exact
counts.

Defined results: null and empty sets are in no pair; null identifiers are
ignored; repeated identifiers and repeated rows of a set count once; an
identifier that joins and leaves in one batch is out; leaving a set it is not
in changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import cut

RARE = 32
BUCKET_ITEMS, SET_BLOCK, ITEM_BLOCK = 1 << 18, 2048, 8192
PAIR, HEAVY, SIZE, MEMBER = range(4)
_BUCKETED = "bucket int, set_id long, kind int, items array<long>"
_DELTAS = "what int, a long, b long, n long, bucket int, items array<long>"


@dataclass
class Overlaps:
    """Signed deltas, to be added up: ``pairs``: a, b, common (by rare identifiers); ``heavy``: set_id, item, n; ``sizes``: set_id, n_items. ``members``: bucket, set_id, items, or None."""

    pairs: DataFrame
    heavy: DataFrame
    sizes: DataFrame
    members: DataFrame | None
    n_buckets: int
    n_members: int = 0

    def summed(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Pair counts, heavy memberships and set sizes as they stand."""
        return (
            self.pairs.groupBy("a", "b").agg(F.sum("common").alias("common")).where("common <> 0"),
            self.heavy.groupBy("set_id", "item").agg(F.sum("n").alias("n")).where("n > 0").select("set_id", "item"),
            self.sizes.groupBy("set_id").agg(F.sum("n_items").alias("n_items")).where("n_items > 0"),
        )


def compacted(state: Overlaps) -> Overlaps:
    """The state with all batches' deltas added up and kept anew."""
    pairs, heavy, sizes = state.summed()
    one = F.lit(1).cast("long").alias("n")
    return replace(state, pairs=cut(pairs), heavy=cut(heavy.select("set_id", "item", one)), sizes=cut(sizes), members=cut(state.members) if state.members is not None else None)


def _mix(items: np.ndarray) -> np.ndarray:
    """Well-spread unsigned hashes of signed identifiers."""
    h = items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(16)


def _spread(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Rows ``set_id, kind, items`` as rows of one bucket of identifiers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            size = np.diff(items.offsets.to_numpy())
            size = np.where(items.is_null().to_numpy(zero_copy_only=False), 0, size)
            flat = items.flatten()
            row = np.repeat(np.arange(batch.num_rows), size)
            whole = ~flat.is_null().to_numpy(zero_copy_only=False)
            row, flat = row[whole], flat.drop_null().to_numpy()
            if not len(flat):
                continue
            bucket = (_mix(flat) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(row * n_buckets + bucket, kind="stable")
            key = (row * n_buckets + bucket)[order]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            edges = pa.array(np.append(start, len(key)), pa.int32())
            key = key[start]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key % n_buckets, pa.int32()), batch.column("set_id").take(pa.array(key // n_buckets)), batch.column("kind").take(pa.array(key // n_buckets)), pa.ListArray.from_arrays(edges, pa.array(flat[order]))],
                ["bucket", "set_id", "kind", "items"],
            )

    return rows.select("set_id", "kind", "items").mapInArrow(run, _BUCKETED)


def _pairs(sets: np.ndarray, item: np.ndarray, sign: int, n_sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (coded) of every identifier in 2 to RARE sets, with *sign*; entries sorted by identifier, then set."""
    start = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(item)))
    codes = []
    for n in np.unique(size[(size > 1) & (size <= RARE)]):
        at = start[size == n][:, None] + np.arange(n)
        i, j = np.triu_indices(n, 1)
        codes.append((sets[at][:, i] * n_sets + sets[at][:, j]).ravel())
    code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    return code, np.full(len(code), sign)


def bucket_deltas(table: pa.Table, keep: bool) -> pa.Table:
    """The deltas of one bucket: kinds 0 (member before), 1 (joins) and -1 (leaves)."""
    items = table["items"].combine_chunks()
    items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
    size = np.diff(items.offsets.to_numpy())
    known, of = np.unique(table["set_id"].to_numpy(), return_inverse=True)
    item, sets, kind = items.flatten().to_numpy(), np.repeat(of, size), np.repeat(table["kind"].to_numpy(), size)
    order = np.lexsort((sets, item))
    item, sets, kind = item[order], sets[order], kind[order]
    first = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (sets[1:] != sets[:-1]))))
    was = np.logical_or.reduceat(kind == 0, first)
    now = (was | np.logical_or.reduceat(kind == 1, first)) & ~np.logical_or.reduceat(kind == -1, first)
    item, sets = item[first], sets[first]
    begin = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
    times = np.diff(np.append(begin, len(item)))

    def per_item(x: np.ndarray) -> np.ndarray:
        return np.repeat(np.add.reduceat(x.astype(np.int64), begin), times)

    changed = per_item(was != now) > 0
    n_was, n_now = per_item(was), per_item(now)
    parts = [_pairs(sets[m], item[m], sign, len(known)) for m, sign in ((changed & now, 1), (changed & was, -1))]
    code, sign = (np.concatenate(z) for z in zip(*parts, strict=True))
    code, at = np.unique(code, return_inverse=True)
    n = np.bincount(at, weights=sign, minlength=len(code)).astype(np.int64)
    code, n = code[n != 0], n[n != 0]
    heavy = (now & (n_now > RARE)).astype(np.int64) - (was & (n_was > RARE))
    h = np.flatnonzero(changed & (heavy != 0))
    net = np.bincount(sets, weights=now.astype(int) - was, minlength=len(known)).astype(np.int64)
    s = np.flatnonzero(net)
    what = [np.full(len(code), PAIR), np.full(len(h), HEAVY), np.full(len(s), SIZE)]
    a, b, c = [known[code // len(known)], known[sets[h]], known[s]], [known[code % len(known)], item[h], np.zeros(len(s), np.int64)], [n, heavy[h], net[s]]
    lists, bucket = [pa.nulls(sum(map(len, what)), pa.list_(pa.int64()))], table["bucket"][0].as_py()
    if keep:
        order = np.lexsort((item, sets))
        order = order[now[order]]
        edge = np.flatnonzero(np.concatenate(([True], sets[order][1:] != sets[order][:-1]))) if len(order) else np.zeros(0, np.int64)
        what, a = [*what, np.full(len(edge), MEMBER)], [*a, known[sets[order][edge]]]
        b, c = [*b, np.zeros(len(edge), np.int64)], [*c, np.zeros(len(edge), np.int64)]
        lists.append(pa.ListArray.from_arrays(pa.array(np.append(edge, len(order)), pa.int32()), pa.array(item[order])))
    return pa.table(
        {"what": pa.array(np.concatenate(what), pa.int32()), "a": np.concatenate(a), "b": np.concatenate(b), "n": np.concatenate(c), "bucket": pa.array(np.full(sum(map(len, what)), bucket), pa.int32()), "items": pa.chunked_array(lists)}
    )


def apply_changes(state: Overlaps | None, changes: DataFrame, keep_members: bool = True) -> Overlaps:
    """The state after *changes* (``set_id long, items array<long>, sign int``: 1 joins, -1 leaves)."""
    changes = changes.where("set_id is not null").select("set_id", F.col("sign").cast("int").alias("kind"), "items")
    if state is None:
        total = changes.agg(F.sum(F.greatest(F.size("items"), F.lit(0)))).first()[0] or 0
        n_buckets = max(1, -(-total // BUCKET_ITEMS))
        rows, others = _spread(changes, n_buckets), None
    else:
        n_buckets, members = state.n_buckets, state.members
        if state.n_members > 2 * BUCKET_ITEMS * n_buckets:
            n_buckets = -(-state.n_members // BUCKET_ITEMS)
            members = cut(_spread(members.select("set_id", F.lit(0).alias("kind"), "items"), n_buckets).drop("kind"))
        changed = cut(_spread(changes, n_buckets))
        touched = changed.select("bucket").distinct()
        rows = changed.unionByName(members.join(touched, "bucket", "left_semi").select("bucket", "set_id", F.lit(0).alias("kind"), "items"))
        others = members.join(touched, "bucket", "left_anti")
    found = cut(rows.groupBy("bucket").applyInArrow(lambda t: bucket_deltas(t, keep_members), _DELTAS))
    pairs = found.where(f"what = {PAIR}").select("a", "b", F.col("n").alias("common"))
    heavy = found.where(f"what = {HEAVY}").select(F.col("a").alias("set_id"), F.col("b").alias("item"), "n")
    sizes = found.where(f"what = {SIZE}").select(F.col("a").alias("set_id"), F.col("n").alias("n_items"))
    kept = found.where(f"what = {MEMBER}").select("bucket", F.col("a").alias("set_id"), "items") if keep_members else None
    n_members = (sizes.agg(F.sum("n_items")).first()[0] or 0) if keep_members else 0
    if state is None:
        return Overlaps(pairs, heavy, sizes, kept, n_buckets, n_members)
    return Overlaps(
        state.pairs.unionByName(pairs), state.heavy.unionByName(heavy), state.sizes.unionByName(sizes),
        others.unionByName(kept) if keep_members else None, n_buckets, state.n_members + n_members,
    )


def _count_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each pair the number of common identifiers that its two lists hold; no intersection is built."""
    for batch in batches:
        parts = []
        for c in ("items_a", "items_b"):
            size = np.where(batch.column(c).is_null().to_numpy(zero_copy_only=False), 0, np.diff(batch.column(c).offsets.to_numpy()))
            parts.append((np.repeat(np.arange(batch.num_rows), size), batch.column(c).flatten().to_numpy()))
        row, item = (np.concatenate(z) for z in zip(*parts, strict=True))
        order = np.lexsort((item, row))
        row, item = row[order], item[order]
        twice = (row[1:] == row[:-1]) & (item[1:] == item[:-1])
        n = np.bincount(row[1:][twice], minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(batch.column("common").to_numpy() + n)], ["a", "b", "n_a", "n_b", "common"])


def _incidence(table: pa.Table, share: float) -> pa.Table:
    """Pairs of a tile whose heavy identifiers alone reach the share of the smaller set."""
    side = table["side"].to_numpy()
    ids, size = table["set_id"].to_numpy(), table["n_items"].to_numpy()
    lists = table["items"].to_pylist()
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    total = np.zeros((len(x), len(y)), np.float32)
    if len(x) and len(y):
        codes = np.unique(np.concatenate([np.array(lists[i], np.int64) for i in x]))
        for at in range(0, len(codes), ITEM_BLOCK):
            part = codes[at : at + ITEM_BLOCK]
            both = []
            for rows in (x, y):
                m = np.zeros((len(rows), len(part)), np.float32)
                for k, i in enumerate(rows):
                    m[k, np.flatnonzero(np.isin(part, np.array(lists[i], np.int64)))] = 1
                both.append(m)
            total += both[0] @ both[1].T
    i, j = np.nonzero(total >= share * np.minimum(size[x][:, None], size[y])) if len(x) and len(y) else (np.zeros(0, int), np.zeros(0, int))
    a, b = ids[x][i], ids[y][j]
    n = total[i, j].astype(np.int64) if len(i) else np.zeros(0, np.int64)
    keep = a != b
    flip = a > b
    na, nb = size[x][i], size[y][j]
    cols = {"a": np.where(flip, b, a), "b": np.where(flip, a, b), "n_a": np.where(flip, nb, na), "n_b": np.where(flip, na, nb), "common": n}
    return pa.table({k: v[keep].astype(np.int64) for k, v in cols.items()})


def estimates(state: Overlaps, share: float) -> DataFrame:
    """``a < b, common, n_a, n_b, jaccard, containment`` of the pairs whose common identifiers are at least *share* of the smaller set."""
    pair_counts, heavy_items, set_sizes = state.summed()
    own = heavy_items.groupBy("set_id").agg(F.collect_list("item").alias("items"))
    info = cut(set_sizes.join(own, "set_id", "left").withColumn("n_heavy", F.greatest(F.size("items"), F.lit(0))))
    light = info.drop("items")
    out = "a long, b long, n_a long, n_b long, common long"

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(F.col("set_id").alias(s), *(F.col(c).alias(f"{c[:1] if c == 'n_items' else 'h' if c == 'n_heavy' else c}_{s}") for c in df.columns if c != "set_id"))

    pairs = cut(pair_counts)
    least = F.least("n_a", "n_b") * F.lit(share)
    open_ = pairs.join(side(light, "a"), "a").join(side(light, "b"), "b").where(F.col("common") + F.least("h_a", "h_b") >= least).select("a", "b", "n_a", "n_b", "common")
    lists = info.select("set_id", "items")
    full = open_.join(lists.select(F.col("set_id").alias("a"), F.col("items").alias("items_a")), "a").join(lists.select(F.col("set_id").alias("b"), F.col("items").alias("items_b")), "b")
    counted = full.mapInArrow(_count_common, out)
    lone = cut(info.where(F.col("n_heavy") >= F.col("n_items") * F.lit(share)).where("n_heavy > 0"))
    n_lone = lone.count()
    if n_lone:
        heavy = info.where("n_heavy > 0")
        blocks = [max(1, -(-n // SET_BLOCK)) for n in (n_lone, heavy.count())]
        own_block = [F.pmod(F.xxhash64("set_id"), F.lit(b)).cast("int") for b in blocks]
        every = [F.explode(F.sequence(F.lit(0), F.lit(b - 1))) for b in reversed(blocks)]
        cols = ["set_id", "n_items", "items"]
        left = lone.select(*cols, F.lit(0).alias("side"), own_block[0].alias("i"), every[0].alias("j"))
        right = heavy.select(*cols, F.lit(1).alias("side"), own_block[1].alias("j"), every[1].alias("i"))
        tiles = left.unionByName(right).groupBy("i", "j").applyInArrow(lambda t: _incidence(t, share), out).distinct()
        counted = counted.unionByName(tiles.join(pairs, ["a", "b"], "left_anti"))
    kept = counted.where(F.col("common") >= least)
    return kept.select(
        "a", "b", "common", "n_a", "n_b",
        (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("jaccard"),
        (F.col("common") / F.least("n_a", "n_b")).alias("containment"),
    )
