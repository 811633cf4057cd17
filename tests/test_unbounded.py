import numpy as np
import pytest

from seqloom.operators import hdbscan
from seqloom.plans import recover as R


def blobs(n=160, seed=4):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [9, 0, 1], [0, 8, 2], [9, 9, 9]])
    x = centres[np.arange(n) % 4] + rng.normal(0, 1, (n, 3)) * (1 + np.arange(n) % 4)[:, None] / 2
    return np.concatenate((x, rng.uniform(-15, 25, (12, 3)), x[:3]))


def parts(labels):
    groups = {}
    for i, v in labels.items():
        groups.setdefault(v, set()).add(i)
    outliers = groups.pop(None, set())
    return outliers, {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("min_samples, min_size, level_links", [(5, 5, 200_000), (3, 9, 200_000), (5, 5, 60)])
def test_unbounded_equals_the_fit_of_one_task(spark, monkeypatch, min_samples, min_size, level_links):
    monkeypatch.setattr(hdbscan, "BLOCK", 50)
    x = blobs()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {r.id: r.label for r in hdbscan.unbounded(rows, min_samples, min_size, level_links).collect()}
    want = {i: None if v < 0 else int(v) for i, v in enumerate(hdbscan.fit(hdbscan.pairwise(x), min_samples, min_size))}
    assert len(set(want.values())) > 2
    assert parts(got) == parts(want) and got == want


def test_groups_beyond_the_bound_do_not_raise(spark, monkeypatch):
    monkeypatch.setattr(hdbscan, "MAX_POINTS", 100)
    x = blobs()
    points = [("hot", i, v.tolist()) for i, v in enumerate(x)] + [("cold", 1000 + i, v.tolist()) for i, v in enumerate(x[:60])]
    rows = R.cluster_each(spark.createDataFrame(points, "bin string, id long, vec array<double>"), "bin").collect()
    assert sorted((r.bin, r.id) for r in rows) == sorted((b, i) for b, i, _ in points)
    assert all(len({r.label for r in rows if r.bin == b} - {None}) > 1 for b in ("hot", "cold"))
