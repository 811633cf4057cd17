import random

import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import cells, density, overlaps, similar

SCHEMA = "id long, vec array<double>, distance string, cls string"


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], "d", "c") for i, r in enumerate(x)] + [(i, v, "d", "c") for i, v in extra]
    return spark.createDataFrame(rows, SCHEMA)


def points(seed=1):
    """Blobs, noise, chains and copies in six dimensions."""
    rng = np.random.default_rng(seed)
    blobs = [rng.normal(c, 0.02, (40, 6)) for c in rng.uniform(0, 3, (5, 6))]
    chain = np.zeros((12, 6))
    chain[:, 0] = np.arange(12) * 0.09 + 5
    return np.concatenate([*blobs, rng.uniform(0, 3, (60, 6)), chain, np.tile([[7.0] * 6], (9, 1))])


NOTHING = [(900, None), (901, [1.0]), (902, [float("nan")] * 6), (903, [None] * 6), (904, [float("inf")] * 6), (None, [0.0] * 6)]


def matrix(x):
    return np.sqrt(((x[:, None] - x) ** 2).sum(2))


@pytest.mark.parametrize("block_rows", [8192, 16])
def test_mutual_pairs_equal_brute_force(spark, block_rows, monkeypatch):
    monkeypatch.setattr(similar.edges_within, "__defaults__", (block_rows,))
    x = points()
    d = matrix(x)
    near = [[j for _, j in sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]] for i in range(len(x))]
    want = {(i, j) for i in range(len(x)) for j in near[i] if i < j and i in near[j] and d[i, j] <= 0.06}
    rows = frame(spark, x, [*NOTHING, (3, x[3].tolist())])
    got = {(r.id_a, r.id_b): r.distance for r in similar.mutual_pairs(rows, 0.06, 4, 6).collect()}
    assert set(got) == want and all(got[p] == pytest.approx(d[p]) for p in want)
    assert similar.mutual_pairs(rows.limit(0), 0.06, 4, 6).count() == 0


@pytest.mark.parametrize("block_rows", [8192, 16])
def test_neighbours_equal_brute_force(spark, block_rows):
    x = points(2)
    d = matrix(x)
    rows = frame(spark, x, NOTHING)
    found = similar.neighbours(rows, rows.where("id % 3 = 0"), 5, 6, block_rows, 50)
    got = {}
    for r in found.collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.neighbour, r.distance)
    assert set(got) == set(range(0, len(x), 3))
    for i, near in got.items():
        want = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:5]
        assert [near[k + 1][1] for k in range(5)] == pytest.approx([v for v, _ in want], abs=1e-12)
        assert [near[k + 1][0] for k in range(5)] == [j for _, j in want]


def test_neighbours_of_few(spark):
    rows = frame(spark, [[0.0] * 6, [1.0] * 6])
    assert {(r.id, r.neighbour, r["rank"]) for r in similar.neighbours(rows, rows, 5, 6).collect()} == {(0, 1, 1), (1, 0, 1)}
    assert similar.neighbours(rows.limit(0), rows.limit(0), 5, 6).count() == 0


def test_survivors_lose_nothing():
    rng = np.random.default_rng(3)
    for scale, dims in ((1, 5), (1e-6, 20), (1e4, 136), (1, 400)):
        x, y = rng.normal(0, scale, (70, dims)), rng.normal(0, scale, (50, dims))
        d = np.sqrt(((x[:, None] - y) ** 2).sum(2))
        r = float(np.quantile(d, 0.2))
        kept = {(int(i), int(j)) for a, b in similar.survivors(x, y, r) for i, j in zip(a, b, strict=True)}
        assert set(zip(*map(lambda z: z.tolist(), np.nonzero(d <= r)), strict=True)) <= kept and len(kept) < d.size
    same = np.zeros((3, 4))
    assert sum(len(i) for i, _ in similar.survivors(same, same, 0.0)) == 9


def components(d, radius):
    label = np.arange(len(d))
    while True:
        new = np.array([label[d[i] <= radius].min() for i in range(len(d))])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("block_rows", [32768, 16])
def test_chained_equals_components(spark, block_rows, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", block_rows)
    x = points(4)
    label = components(matrix(x), 0.1)
    want = {i: int(v) for i, v in enumerate(label) if (label == v).sum() >= 5}
    rows = frame(spark, x, [*NOTHING, (3, x[3].tolist())])
    assert {r.id: r.cluster_key for r in density.chained(rows, 0.1, 5, 6).collect()} == want
    assert density.chained(rows.limit(0), 0.1, 5, 6).count() == 0


def tree_weight(d, most):
    root, total = list(range(len(d))), 0.0

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for w, i, j in sorted((d[i, j], i, j) for i in range(len(d)) for j in range(i)):
        if w <= most and find(i) != find(j):
            root[find(i)], total = find(j), total + w
    return total


def test_dense_and_cross_forests():
    rng = np.random.default_rng(5)
    d = matrix(rng.normal(size=(40, 3)))
    full = d.copy()
    np.fill_diagonal(full, np.inf)
    i, j = density.dense_forest(full, 1.0)
    assert d[i, j].sum() == pytest.approx(tree_weight(d, 1.0))
    cross = np.full((40, 40), np.inf)
    cross[:25, 25:], cross[25:, :25] = d[:25, 25:], d[25:, :25]
    i, j = density.cross_forest(d[:25, 25:], 1.0)
    assert d[i, j + 25].sum() == pytest.approx(tree_weight(cross, 1.0))
    a, b = np.nonzero(np.triu(d <= 1.0, 1))
    kept = density.sparse_forest(40, a, b, d[a, b])
    assert d[a[kept], b[kept]].sum() == pytest.approx(tree_weight(d, 1.0))


def test_sparse_forest_with_ties():
    rng = np.random.default_rng(6)
    for n, m in ((1, 0), (2, 1), (30, 25), (50, 400)):
        i, j, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 4, m).astype(float)
        d = np.full((n, n), np.inf)
        for a, b, v in zip(i, j, w, strict=True):
            if a != b:
                d[a, b] = d[b, a] = min(v, d[a, b])
        assert w[density.sparse_forest(n, i, j, w)].sum() == tree_weight(d, 9)


def plain_condensed(d, min_samples, min_size, most):
    """Stable clusters of the mutual reachability graph up to *most*, by cutting at every weight."""
    core = np.sort(d, axis=1)[:, min_samples - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core)
    np.fill_diagonal(reach, core)
    floor = most * 1e-3
    weights = sorted({float(w) for w in reach[np.triu_indices(len(d), 1)] if w <= most})
    alive = np.flatnonzero(core <= most)

    def parts(members, w, strict):
        left, out = set(members), []
        while left:
            group, todo = set(), [min(left)]
            while todo:
                i = todo.pop()
                if i in group:
                    continue
                group.add(i)
                todo += [j for j in left if j not in group and j != i and (reach[i, j] < w if strict else reach[i, j] <= w)]
            left -= group
            out.append(sorted(group))
        return out

    def solve(members, birth):
        """Best stability of a cluster born at density *birth*, and the clusters that give it."""
        inside, total = list(members), 0.0
        for w in reversed(weights):
            split = parts(inside, w, True)
            if len(split) == 1:
                continue
            lam = 1 / (w + floor)
            big = [p for p in split if len(p) >= min_size]
            if len(big) == 1:
                total += (len(inside) - len(big[0])) * (lam - birth)
                inside = big[0]
                continue
            total += len(inside) * (lam - birth)
            below = [solve(p, lam) for p in big]
            best = sum(b for b, _ in below)
            return (total, [sorted(members)]) if total >= best else (best, [c for _, cs in below for c in cs])
        return total, [sorted(members)]

    out = []
    for p in parts(alive.tolist(), most, False):
        if len(p) >= min_size:
            out += solve(p, 1 / (most + floor))[1]
    return {tuple(c) for c in out}


@pytest.mark.parametrize("level_links", [200_000, 15])
def test_stable_clusters_equal_cutting_at_every_weight(spark, level_links):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.05, (14, 6)), rng.normal(0.3, 0.05, (12, 6)), rng.normal(2, 0.1, (15, 6)), rng.uniform(-1, 3, (8, 6))])
    want = plain_condensed(matrix(x), 3, 5, 0.9)
    rows = density.cluster(frame(spark, x, NOTHING), 6, 0.9, 3, 5, level_links).collect()
    assert {r.id for r in rows} == set(range(len(x)))
    got = {}
    for r in rows:
        if r.cluster is not None:
            got.setdefault(r.cluster, []).append(r.id)
    # members that leave a cluster before it ends stay its members
    assert len(got) == len(want) >= 2
    assert {tuple(sorted(c)) for c in got.values()} == want


def test_copies_and_exemplars(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.tile([[0.0] * 6], (7, 1)), rng.normal(1, 0.02, (9, 6))])
    rows = density.cluster(frame(spark, x), 6, 0.5, 3, 5)
    lengths = spark.createDataFrame([(i, 10 * i) for i in range(12)], "id long, length long")
    got = {r.cluster_key: r for r in density.describe(rows, lengths).collect()}
    assert (got[0].n_contigs, got[0].bin_size, got[0].exemplars) == (7, 210, [0, 1, 2, 3, 4])
    assert got[7].n_contigs == 9 and len(got[7].exemplars) == 5
    assert density.cluster(frame(spark, x).limit(0), 6, 0.5, 3, 5).count() == 0


def test_cells_meet_every_near_pair():
    x = points(9)
    d = matrix(x)
    for radius in (0.02, 0.3, 1.5):
        c = cells.fit(x, len(x), radius, 20)
        to = c.distances(x)
        home, near = c.homes(to)
        row, cell = c.visits(to, home, near, radius)
        at = {(i, int(h)) for i, h in enumerate(home)} | set(zip(row.tolist(), cell.tolist(), strict=True)) | {(i, len(c.pivots)) for i in np.flatnonzero(home == len(c.pivots))}
        for i, j in zip(*np.nonzero(d <= radius), strict=True):
            assert (i, int(home[j])) in at or (j, int(home[i])) in at


# --- overlaps ---


def plain_pairs(sets, share):
    out = {}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and n and n >= share * min(len(sets[a]), len(sets[b])):
                out[a, b] = (n, len(sets[a]), len(sets[b]))
    return out


def random_sets(rng, n):
    """Sets with families, and identifiers that nearly all sets have."""
    common = list(range(1000, 1020))
    families = [rng.sample(range(10_000, 20_000), 60) for _ in range(8)]
    return {i: set(rng.sample(rng.choice(families), rng.randrange(5, 50)) + rng.sample(common, rng.randrange(20)) + [rng.randrange(-(2**62), 2**62)]) for i in range(n)} | {
        n: set(common[:9]), n + 1: set(common[:12]), n + 2: set(), n + 3: {5}
    }


def changes(spark, rows):
    return spark.createDataFrame([(s, list(i) if i is not None else None, g, "x") for s, i, g in rows], "set_id long, items array<long>, sign int, bucket string")


def found(state, share):
    return {(r.a, r.b): (r.common, r.n_a, r.n_b) for r in overlaps.estimates(state, share).collect()}


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(1)
    sets = random_sets(rng, 90)
    rows = [(s, [*items, *list(items)[:2]], 1) for s, items in sets.items()] + [(7, list(sets[7]), 1), (8, [None], 1), (None, [1], 1), (500, None, 1)]
    state = overlaps.apply_changes(None, changes(spark, rows))
    for share in (0.5, 0.1):
        assert found(state, share) == plain_pairs(sets, share)
    row = overlaps.estimates(state, 0.5).first()
    assert row.jaccard == row.common / (row.n_a + row.n_b - row.common) and row.containment == row.common / min(row.n_a, row.n_b)


def test_overlaps_by_deltas(spark):
    rng = random.Random(2)
    sets = random_sets(rng, 70)
    state = overlaps.apply_changes(None, changes(spark, [(s, items, 1) for s, items in sets.items()]))
    for _ in range(2):
        moves = []
        for s in rng.sample(sorted(sets), 40):
            gone = set(rng.sample(sorted(sets[s]), len(sets[s]) // 2))
            new = set(rng.sample(range(10_000, 20_000), 3)) | set(rng.sample(range(1000, 1020), 4)) - gone
            sets[s] = (sets[s] | new) - gone
            moves += [(s, gone, -1), (s, new, 1), (s, [77], -1)]
        state = overlaps.apply_changes(state, changes(spark, moves))
        assert found(state, 0.4) == plain_pairs(sets, 0.4)


def test_no_sets(spark):
    state = overlaps.apply_changes(None, changes(spark, []))
    assert found(state, 0.5) == {}


def test_pairs_of_heavy_identifiers_only(spark):
    shared = list(range(50))
    sets = {i: set(shared[: 10 + i % 3]) for i in range(120)}
    state = overlaps.apply_changes(None, changes(spark, [(s, items, 1) for s, items in sets.items()]))
    assert state.pairs.count() == 0 and found(state, 0.9) == plain_pairs(sets, 0.9)


def test_bucket_kernel_takes_sorted_and_unsorted():
    table = pa.table({"bucket": pa.array([0, 0], pa.int32()), "set_id": [2, 1], "kind": pa.array([1, 1], pa.int32()), "items": pa.array([[9, 3, 3], [3, 9]], pa.list_(pa.int64()))})
    rows = overlaps.bucket_deltas(table, False).to_pylist()
    assert [(r["a"], r["b"], r["n"]) for r in rows if r["what"] == overlaps.PAIR] == [(1, 2, 2)]


def test_roots_are_the_cut_and_levels_change_nothing(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate((rng.normal(0, 1, (60, 3)), rng.normal(6, 0.7, (50, 3)), rng.normal(6, 0.1, (20, 3)) + 2, rng.uniform(-30, 30, (15, 3))))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, x[0].tolist())], "id long, vec array<double>")

    def groups(df):
        out = {}
        for r in df.where("cluster is not null").collect():
            out.setdefault(r.cluster, set()).add(r.id)
        return {frozenset(g) for g in out.values()}

    whole = groups(density.cluster(rows, 3, 2.0))
    assert len(whole) > 1 and whole == groups(density.cluster(rows, 3, 2.0, level_links=30))
    near = np.linalg.norm(x[:, None] - x, axis=2) <= 1.2
    reach = near.copy()
    for _ in range(9):
        reach = (reach.astype(int) @ reach) > 0
    # the copy of row 0 belongs with it
    want = {frozenset([*np.flatnonzero(r), *([500] if r[0] else [])]) for r in reach}
    got = {}
    for r in density.chained(rows, 1.2, 5, 3).collect():
        got.setdefault(r.cluster_key, set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == {g for g in want if len(g) >= 5}


def test_a_delta_reads_its_buckets_only_and_buckets_are_split_anew(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "BUCKET_ITEMS", 20)
    sets = {s: set(range(s, s + 60)) for s in range(4)}
    state = overlaps.apply_changes(None, changes(spark, [(s, list(items), 1) for s, items in sets.items()]))
    assert state.n_buckets == 12 and state.n_members == 240
    # one identifier changes one bucket; the members of the others stay where they are
    after = overlaps.apply_changes(state, changes(spark, [(0, [1000], 1)]))
    bucket = int(overlaps._mix(np.array([1000]))[0] % np.uint64(12))
    before = {(r.bucket, r.set_id): sorted(r["items"]) for r in state.members.collect()}
    now = {(r.bucket, r.set_id): sorted(r["items"]) for r in after.members.collect()}
    assert {k for k in now if now[k] != before.get(k)} == {(bucket, 0)} and after.n_members == 241
    assert after.pairs.count() == state.pairs.count()
    more = {s: set(range(200, 500)) for s in (1, 2)}
    grown = overlaps.apply_changes(after, changes(spark, [(s, list(items), 1) for s, items in more.items()]))
    last = overlaps.compacted(overlaps.apply_changes(grown, changes(spark, [(3, [5], -1)])))
    assert last.n_buckets > 12
    sets = {s: items | more.get(s, set()) for s, items in sets.items()}
    sets[0].add(1000)
    sets[3].discard(5)
    assert found(last, 0.1) == plain_pairs(sets, 0.1)
