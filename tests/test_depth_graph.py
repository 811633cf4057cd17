import numpy as np
import pytest

from seqloom.operators import blocks as B
from seqloom.operators import sketched
from seqloom.plans import recover as R


def planted(n=90, families=30):
    """Contigs of a family share a sketch but not a depth; some sketches are empty, and one hash is in most."""
    rng = np.random.default_rng(5)
    cov = np.abs(rng.normal(30, 12, (n, 4))) + 1
    shared = [set(map(int, rng.integers(-(1 << 62), 1 << 62, 12))) for _ in range(families)]
    sketches = [sorted(list(shared[i % families])[: int(rng.integers(8, 13))] + [7] * (i % 4 > 0)) for i in range(n)]
    for i in (0, 40, 41):
        sketches[i] = []
    return cov, sketches


def brute(cov, sketches, k, kernel):
    out = {}
    d = kernel(cov, cov)
    for i, x in enumerate(sketches):
        row = []
        for j, y in enumerate(sketches):
            least = min(len(x), len(y))
            sketch = 1 - len(set(x) & set(y)) / least if least else float(bool(x or y))
            row += [(d[i, j] * sketch, j)] if i != j else []
        out[i] = sorted(row)[:k]
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_depth_graph_equals_brute_force(spark, monkeypatch, strict):
    cov, sketches = planted()
    rows = spark.createDataFrame([(i, c.tolist(), h) for i, (c, h) in enumerate(zip(cov, sketches, strict=True))], "id long, cov array<double>, hashes array<long>")
    got = {}
    for r in R.depth_graph(rows, 2, 3, strict).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append((r.distance, r.dst))
    want = brute(cov, sketches, 3, B.coverage_strict if strict else B.coverage)
    assert {i: [j for _, j in x] for i, x in got.items()} == {i: [j for _, j in x] for i, x in want.items()}
    assert all(np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]]) for i in want)


def test_common_hashes_of_rare_and_hot_hashes(monkeypatch):
    monkeypatch.setattr(sketched, "PAIRS", 50)
    monkeypatch.setattr(sketched, "WIDE", 2)
    rng = np.random.default_rng(1)
    sets = [sorted(set(rng.integers(0, 60, 30)) | {100, 101, 102}) for _ in range(40)]

    def side(part):
        h, at = np.concatenate(part), np.repeat(np.arange(len(part)), [len(x) for x in part])
        order = np.argsort(h, kind="stable")
        return h[order], at[order], len(part)

    want = [[len(set(x) & set(y)) for y in sets[15:]] for x in sets[:25]]
    assert (sketched.common_hashes(*side(sets[:25]), *side(sets[15:])) == want).all()
