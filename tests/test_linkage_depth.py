import numpy as np
import pytest

from seqloom.operators import blocks as B


def told(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The formula of ``areas`` pair by pair."""
    out = np.ones((len(x), len(y)))
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            area = B.areas(a[0::2], a[1::2], b[0::2], b[1::2], False)
            area = area[~np.isnan(area)]
            out[i, j] = np.exp(np.log(area).mean()) if len(area) else 1.0
    return out


def depths(n: int, samples: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.abs(rng.normal(20, 30, (n, 2 * samples))) * (rng.random((n, 2 * samples)) < 0.8)
    x[0], x[1] = 0, 0  # no depth at all
    x[3] = x[2]
    x[5] = x[4]
    x[5, 1] += 5e-5  # variances that count as equal
    x[7] = x[6]
    x[7, 0] += 1e-9
    x[9] = x[8] * 1e4  # crossings far in the tails
    return x


@pytest.mark.parametrize("samples", [1, 5, 70])
def test_coverage_equals_the_formula_of_each_pair(samples, monkeypatch):
    x = depths(24, samples)
    want = told(x, x[:17])
    assert B.coverage(x, x[:17]) == pytest.approx(want, abs=1e-11)
    monkeypatch.setattr(B, "STRIP", 40)
    assert B.coverage(x, x[:17]) == pytest.approx(want, abs=1e-11)
    assert B.coverage(x[:0], x).shape == (0, 24)
    assert B.coverage(x, x[:0]).shape == (24, 0)


def test_pair_sums_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    few = depths(12, 2)
    x = np.concatenate([few[rng.integers(0, 12, 60)], depths(40, 2, 8)])
    labels = rng.integers(-1, 4, len(x))
    rows = [(int(l), [float(v) for v in r]) for l, r in zip(labels, x, strict=True)]
    rows += [(None, rows[0][1]), (1, None), (1, [1.0]), (2, [float("nan"), 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "label int, vec array<double>")
    d = told(x, x)
    for size, spread in ((4, 3), (2048, 12)):
        got = {(r.label, r.other_label): (r.total, r.n) for r in B.pair_sums(frame, B.coverage, 4, size, spread).collect()}
        assert set(got) == {(a, b) for a in range(-1, 4) for b in range(-1, 4) if a != b}
        for (a, b), (total, n) in got.items():
            part = d[np.ix_(labels == a, labels == b)]
            assert (total, n) == (pytest.approx(part.sum(), rel=1e-9), part.size)


def test_pair_sums_measure_equal_vectors_once(spark):
    def kernel(x, y):
        assert len(x) <= 3 and len(y) <= 3, "copies were measured"
        return B.euclid(x, y)

    frame = spark.createDataFrame([(i % 2, [float(i % 3), 0.0]) for i in range(600)], "label int, vec array<double>")
    got = {(r.label, r.other_label): (r.total, r.n) for r in B.pair_sums(frame, kernel, 2).collect()}
    # each label has each of the three vectors 100 times
    assert got == {k: (pytest.approx(10_000 * 8), 90_000) for k in ((0, 1), (1, 0))}
    assert B.pair_sums(frame.limit(0), kernel, 2).count() == 0
