import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import blocks as B
from seqloom.operators import embedding, graphs, hdbscan
from seqloom.operators import tables as T


def frame(spark, x, labels=None):
    labels = [0] * len(x) if labels is None else labels
    return spark.createDataFrame([(i, int(l) if l is not None else None, [float(v) for v in r] if r is not None else None) for i, (r, l) in enumerate(zip(x, labels, strict=True))], "id long, label int, vec array<double>")


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 0.1, (30, 3)), rng.normal(3, 0.1, (25, 3)), [[9, 9, 9]]])
    return x, np.array([0] * 30 + [1] * 25 + [-1])


def test_search_equals_brute_force(spark, blobs):
    x = blobs[0]
    rows = frame(spark, [*x, None, [1.0], [float("nan"), 0, 0]])
    found = B.search(B.pack(rows.where("id % 5 = 0"), "id", "vec", 3, 4), B.pack(rows, "id", "vec", 3, 16), B.euclid, 4, 3)
    got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in found.collect()}
    d = np.linalg.norm(x[:, None] - x, axis=2)
    for i in range(0, len(x), 5):
        near = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]
        assert [got[i, k + 1][0] for k in range(4)] == [j for _, j in near]
        assert [got[i, k + 1][1] for k in range(4)] == pytest.approx([v for v, _ in near])
    assert B.search(B.pack(rows.limit(0), "id", "vec", 3), B.pack(rows, "id", "vec", 3), B.euclid, 4, 3).count() == 0


def test_label_sums_and_means(spark, blobs):
    x, labels = blobs
    d = np.linalg.norm(x[:, None] - x, axis=2)
    rows = frame(spark, x, [None if v < 0 else v for v in labels])
    sums = B.label_sums(B.pack(rows, "id", "vec", 3, 16, label="label"), B.euclid, 3).cache()
    link = {(r.label, r.other_label): r.mean_distance for r in B.linkage(sums).collect()}
    assert link[0, 1] == pytest.approx(d[:30, 30:55].mean())
    got = {r.id: r.silhouette for r in B.silhouettes(sums).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(hdbscan.silhouette(d, labels).tolist())
    means = {r.label: r.mean_distance for r in B.within_means(B.pack(rows, "id", "vec", 3, 8, label="label", by_label=True), B.euclid, 3).collect()}
    assert means[0] == pytest.approx(d[:30, :30][np.triu_indices(30, 1)].mean()) and np.isnan(means[-1])


def test_euclid_of_near_vectors():
    x = np.array([[1e4, 1.0], [1e4, 1.0 + 1e-9]])
    assert B.euclid(x, x)[0, 1] == pytest.approx(1e-9, rel=1e-3)


def test_hdbscan_finds_blobs(blobs):
    x, labels = blobs
    d = hdbscan.pairwise(x)
    assert hdbscan.fit(d, 3, 5).tolist() == labels.tolist()
    assert hdbscan.fit(hdbscan.pairwise(x[:30]), 3, 5, allow_single=True).max() == 0
    assert hdbscan.fit(d[:1, :1], 3, 5).tolist() == [-1]
    assert set(hdbscan.best_labels(d)[:30]) == {0}
    with pytest.raises(ValueError, match="at most"):
        hdbscan.checked(hdbscan.MAX_POINTS + 1)


def test_silhouette_of_one_cluster_is_zero(blobs):
    d = hdbscan.pairwise(blobs[0])
    assert hdbscan.silhouette(d, np.zeros(len(d), int)).sum() == 0


def test_grid_and_groups(spark, blobs):
    x, labels = blobs
    rows = frame(spark, x)
    scores = hdbscan.grid_scores(rows, "id", "vec", range(2, 5), range(5, 7)).collect()
    assert len(scores) == 6 and all(-1 <= r.score <= 1 for r in scores)
    both = rows.unionByName(rows.withColumn("label", F.lit(1))).withColumnRenamed("label", "bin")
    got = hdbscan.cluster_groups(both, ["bin"], "id", "vec", 3, 5).collect()
    for b in (0, 1):
        assert {r.id: r.label for r in got if r.bin == b} == {i: (None if v < 0 else v) for i, v in enumerate(labels)}


def test_graphs(spark):
    # five points on a line at 0, 1, 2, 3 and 9: the last is nobody's neighbour
    edges = spark.createDataFrame([(0, 1, 1.0, 1), (1, 0, 1.0, 1), (1, 2, 1.0, 2), (2, 1, 1.0, 1), (2, 3, 1.0, 2), (3, 2, 1.0, 1), (9, 3, 6.0, 1)], "src long, dst long, distance double, rank int")
    pick = lambda df: {(r.src, r.dst) for r in df.collect()}
    assert pick(graphs.mutual(edges, 0)) == pick(edges) - {(9, 3)}
    assert pick(graphs.mutual(edges, 1)) == pick(edges)
    assert pick(graphs.intersect(edges, edges.where("src = 1"), 0)) == {(0, 1), (2, 1)}
    assert pick(graphs.combined(edges, edges.limit(0), 0, prune=False)) == pick(edges)
    nodes = spark.createDataFrame([(0,), (1,), (2,), (3,), (9,)], "src long")
    assert [r.src for r in graphs.disconnected(nodes, graphs.mutual(edges, 0)).collect()] == [9]

    def build(left, keep_n):
        return graphs.mutual(edges.join(left, "src", "left_semi"), keep_n)

    kept, _, gone = graphs.prefilter(nodes, build, 0, 1)
    assert {r.src for r in kept.collect()} == {0, 1, 2, 3} and [r.src for r in gone.collect()] == [9]


def test_prefilter_goes_on_beyond_fifty_rounds(spark):
    # a chain that loses its last node every round
    nodes = spark.range(60).select(F.col("id").alias("src"))
    seen = []

    def build(kept, keep_n):
        seen.append(keep_n)
        last = 60 - len(seen)
        return kept.where(F.col("src") < last).select("src", F.lit(0).cast("long").alias("dst"), F.lit(1.0).alias("distance"), F.lit(1).alias("rank")) if len(seen) < 54 else kept.select("src", F.lit(0).cast("long").alias("dst"), F.lit(1.0).alias("distance"), F.lit(1).alias("rank"))

    kept, edges, gone = graphs.prefilter(nodes, build, 0, 2, rounds=3)
    assert sorted(r.src for r in kept.collect()) == list(range(7)) and gone.count() == 53 and edges.count() == 7
    assert seen[:5] == [0, 0, 0, 2, 4]


def test_numbers_per_key_go_on_across_ranges(spark):
    rows = [("hot" if i % 3 else None, i * 7 % 101) for i in range(100)]
    got = T.numbered(spark.createDataFrame(rows, "k string, x int"), ["k"], ["x"], "n", parts=5).collect()
    for key in ("hot", None):
        mine = sorted((r.x, r.n) for r in got if r.k == key)
        assert [n for _, n in mine] == list(range(len(mine))) and [x for x, _ in mine] == sorted(x for k, x in rows if k == key)


def test_embedding_keeps_blobs_apart(spark, blobs):
    x = blobs[0][:55]
    packed = B.pack(frame(spark, x), "id", "vec", 3)
    edges = B.search(packed, packed, B.euclid, 6, 3).selectExpr("id as src", "neighbour as dst", "distance", "rank")
    out = embedding.embed_with_retry(lambda k: edges, 6, 2).collect()
    y = np.array([r.vec for r in sorted(out, key=lambda r: r.id)])
    within = np.linalg.norm(y[:30] - y[:30].mean(0), axis=1).mean()
    assert np.linalg.norm(y[:30].mean(0) - y[30:].mean(0)) > 2 * within
