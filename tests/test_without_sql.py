"""The queries that SQL cannot express, against plain versions."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from seqloom.operators import hdbscan
from seqloom.plans import vectors as Q

DATA = Path("/root/testdata/sf0.001")


def plain_hdbscan(d, min_samples, min_size):
    """From the definition: clusters are components of at least *min_size* as the distance falls, chosen by excess of mass; the whole is none."""
    n = len(d)
    core = np.sort(d, axis=1)[:, min(min_samples, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core))

    def parts(members, below):
        """Components of *members* by links shorter than *below*."""
        left, out = set(members), []
        while left:
            group, edge = set(), [left.pop()]
            while edge:
                i = edge.pop()
                group.add(i)
                near = {j for j in left if reach[i, j] < below}
                left -= near
                edge += near
            out.append(sorted(group))
        return out

    def grow(members, birth):
        """(stability of the best choice, its clusters) of the cluster *members* born at density *birth*."""
        mass, now = 0.0, members
        while True:
            # the longest link that still holds the members together: the least that leaves them whole, searched among all lengths
            lengths = sorted({reach[i, j] for i in now for j in now if i < j})
            low, high = 0, len(lengths) - 1
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if len(parts(now, np.nextafter(lengths[mid], np.inf))) == 1 else (mid + 1, high)
            longest = lengths[low]
            density = 1 / max(longest, 1e-12)
            big = [p for p in parts(now, longest) if len(p) >= min_size]
            if len(big) == 1:
                mass += (density - birth) * (len(now) - len(big[0]))
                now = big[0]
                continue
            mass += (density - birth) * len(now)
            below = [grow(p, density) for p in big]
            best = sum(s for s, _ in below)
            return (mass, [members]) if mass >= best else (best, [c for _, cs in below for c in cs])

    labels = np.full(n, -1)
    if n < max(2, min_size):
        return labels
    # the whole may be left for its largest part before it splits, but is never chosen
    now = list(range(n))
    while True:
        lengths = sorted({reach[i, j] for i in now for j in now if i < j})
        longest = next(x for x in lengths if len(parts(now, np.nextafter(x, np.inf))) == 1)
        big = [p for p in parts(now, longest) if len(p) >= min_size]
        if len(big) != 1:
            break
        now = big[0]
    found = [c for p in big for c in grow(p, 1 / longest)[1]]
    for k, members in enumerate(sorted(found, key=min)):
        labels[members] = k
    return labels


@pytest.mark.parametrize("min_samples, min_size", [(1, 2), (3, 3), (5, 4)])
def test_fit_equals_the_definition(min_samples, min_size):
    rng = np.random.default_rng(min_size)
    x = np.concatenate((rng.normal(0, 1, (18, 2)), rng.normal(7, 0.6, (14, 2)), rng.normal((7, 9), 0.3, (9, 2)), rng.uniform(-9, 15, (5, 2))))
    d = hdbscan.pairwise(x)
    assert hdbscan.fit(d, min_samples, min_size).tolist() == plain_hdbscan(d, min_samples, min_size).tolist()


@pytest.fixture(scope="module")
def vectors():
    rows = duckdb.sql(f"select vec_id, embedding from '{DATA}/embeddings.parquet' order by vec_id").fetchall()
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.float32).astype(float)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_grid_best_and_labels(spark, vectors):
    ids, x = vectors
    d = hdbscan.pairwise(x)
    grid = {(r.min_cluster_size, r.min_samples): r for r in Q.hdbscan_grid(spark, str(DATA)).collect()}
    assert grid.keys() == {(s, m) for s in range(2, 12) for m in range(5, 15)}
    for key, r in grid.items():
        labels = hdbscan.fit(d, key[1], key[0])
        score = hdbscan.silhouette(d, labels).sum() / len(ids)
        assert r.score == pytest.approx(0 if math.isnan(score) else score, abs=2e-6)
        assert (r.n_clusters, r.n_outliers) == (labels.max() + 1, (labels < 0).sum())
    best = Q.hdbscan_best(spark, str(DATA)).first()
    top = max(grid.values(), key=lambda r: (r.score, -r.min_cluster_size, -r.min_samples))
    assert best.score == pytest.approx(top.score, abs=2e-6)
    got = {r.id: r.label for r in Q.hdbscan_labels(spark, str(DATA)).collect()}
    labels = hdbscan.best_labels(d)
    assert got == {i: None if v < 0 else v for i, v in zip(ids, labels.tolist(), strict=True)}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_prefilter_nodes(spark, vectors):
    ids, x = vectors
    kept = list(range(len(ids)))
    gone = set()
    while True:
        near = {}
        for i in kept:
            order = sorted((round(float(np.linalg.norm(x[i] - x[j])), Q.DIGITS), ids[j], j) for j in kept if j != i)
            near[i] = {j for _, _, j in order[: Q.NEAREST]}
        # from the second round on, each node's nearest ones are kept anyway
        alone = {i for i in kept if not any(i in near[j] for j in near[i])} if not gone else set()
        if not alone:
            break
        gone |= {ids[i] for i in alone}
        kept = [i for i in kept if i not in alone]
    got = {r.src: r.kept for r in Q.prefilter_nodes(spark, str(DATA)).collect()}
    assert got == {i: i not in gone for i in ids}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_layout_places_every_row(spark, vectors):
    ids, x = vectors
    got = {r.id: (r.x, r.y) for r in Q.embedding_layout(spark, str(DATA)).collect()}
    assert got.keys() == set(ids) and all(math.isfinite(v) for p in got.values() for v in p)
    place = np.array([got[i] for i in ids])
    d, e = np.linalg.norm(x[:, None] - x, axis=2), np.linalg.norm(place[:, None] - place, axis=2)
    np.fill_diagonal(d, np.inf)
    nearest = d.argmin(1)
    # a row's nearest lies nearer in the layout than rows do on average
    assert np.mean(e[np.arange(len(ids)), nearest]) < 0.8 * e.sum() / (len(ids) * (len(ids) - 1))
