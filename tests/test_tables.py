import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import assignments as A
from seqloom.operators import ranks
from seqloom.operators import spanning
from seqloom.operators import tables as T


def test_running_sum_equals_a_plain_one(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", None]), rng.randrange(5), i, rng.choice([1, 2, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, b int, i int, v long")
    got = {r.i: r.s for r in ranks.running_sum(df, ["k"], F.col("b"), ["i"], F.col("v"), "s").collect()}
    for k, b, i, _ in rows:
        assert got[i] == sum(r[3] or 0 for r in rows if r[0] == k and (r[1], r[2]) < (b, i))


def test_row_index(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1, 1)], "v int")
    assert [tuple(r) for r in T.row_index(df, ["v"]).orderBy("row_index").collect()] == [(1, 0), (1, 1), (3, 2), (5, 3), (9, 4)]
    assert T.row_index(df.limit(0), ["v"]).count() == 0


def test_forest_equals_kruskal(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice([0.0, 0.5, 1.0, 2.0])) for _ in range(90)]
    extra = [(1, 1, 0.1), (None, 2, 0.1), (2, 3, None), (4, 5, float("nan"))]
    tree = spanning.forest(spark.createDataFrame(edges + edges[:9] + extra, "a long, b long, weight double"))
    root = list(range(60))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    total = count = 0
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a != b):
        if find(a) != find(b):
            root[find(b)] = find(a)
            total, count = total + w, count + 1
    got = tree.edges.collect()
    assert len(got) == count and sum(r.weight for r in got) == pytest.approx(total)
    known = {n for a, b, _ in edges if a != b for n in (a, b)}
    assert {r.node: r.component for r in tree.nodes.collect()} == {n: min(m for m in known if find(m) == find(n)) for n in known}


def test_forest_of_nothing(spark):
    tree = spanning.forest(spark.createDataFrame([], "a long, b long, weight double"))
    assert tree.edges.count() == 0 and tree.nodes.count() == 0


def test_coverage_is_the_last_received(spark):
    rows = [
        (1, "k1 len=3", 3, "s", 1.0, 2.0, "2024-01-01"), (2, " k1", 3, "s", 5.0, 2.0, "2024-03-01"), (3, "k1", 3, "s", 9.0, 2.0, "2024-02-01"),
        (4, "k1", 3, "t", None, 2.0, "2024-01-01"), (5, None, 3, "s", 1.0, 2.0, "2024-01-01"), (6, "k2", None, "t", 4.0, None, None), (7, "k2", None, "t", 4.5, None, None),
    ]
    df = spark.createDataFrame(rows, "cov_id long, contig string, contig_len long, sample_name string, mean_depth double, var_depth double, received_at string")
    long = T.long_coverage(df)
    assert {tuple(r) for r in long.collect()} == {("k1", 3, "s", 5.0, 2.0), ("k2", None, "t", 4.5, None)}
    assert {tuple(r) for r in T.wide_coverage(long, ["s", "t"]).collect()} == {("k1", 5.0, 2.0, None, None), ("k2", None, None, 4.5, None)}
    assert T.long_coverage(df.limit(0)).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([(1, 10), (2, 5), (3, None), (None, 20)], "id long, n long")
    kept, dropped = T.by_length(df, "n", 6)
    assert {r.id for r in kept.collect()} == {1, None} and {r.id for r in dropped.collect()} == {2, 3}
    other = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    assert {r.id for r in T.without(df, other, "id").collect()} == {2, 3, None}
    assert [r.id for r in T.only(df, other, "id").collect()] == [1]


def test_merge_and_mismatch(spark):
    schema = "contig string, contig_len long, sample_name string, mean double, var double"
    a = spark.createDataFrame([("x", 1, "s", 1.0, 0.0), ("y", 1, "s", 2.0, 0.0)], schema)
    b = spark.createDataFrame([("x", 1, "t", 3.0, 0.0), ("x", 1, "s", 7.0, 0.0), ("z", 1, "t", 3.0, 0.0)], schema)
    merged = T.merge([a, b])
    assert {(r.contig, r.avg_depth) for r in T.average_depth(merged).collect()} == {("x", 2.0), ("y", 2.0), ("z", 3.0)}
    assert {r.contig for r in T.contig_mismatch(a, b).collect()} == {"y", "z"}


def test_sample_names_and_manifest_filters(spark):
    df = spark.createDataFrame([("p/x.bam", "paired"), ("y Mean", "long"), ("z", "single")], "sample_name string, kind string")
    assert [r[0] for r in df.select(T.sample_name(F.col("sample_name"))).collect()] == ["x", "y", "z"]
    assert {r.kind for r in T.missing_samples(df, df.where("kind = 'paired'")).collect()} == {"long", "single"}
    assert T.of_kinds(df, ["single"]).count() == 1


MEMBERS = [(1, 0, 1, 100), (1, 1, 2, 50), (1, 1, 3, 60), (1, 2, 4, 500), (1, None, 5, 900), (1, None, 6, 10), (1, 2, 7, None)]


@pytest.fixture(scope="module")
def members(spark):
    return spark.createDataFrame(MEMBERS, "run_id int, label int, contig_idx long, contig_len long")


def test_gates(members):
    keys = ("run_id", "label")
    assert {tuple(r) for r in A.bin_sizes(members).collect()} == {(1, 0, 1, 100), (1, 1, 2, 110), (1, 2, 2, 500)}
    assert {r.contig_idx: r.kept_label for r in A.gate_by_size(members, keys, 105).collect()} == {1: None, 2: 1, 3: 1, 4: 2, 5: None, 6: None, 7: 2}
    assert {r.contig_idx: r.folded_label for r in A.fold_small(members, keys, 200).collect()} == {1: 0, 2: 0, 3: 0, 4: 2, 5: None, 6: None, 7: 2}
    assert {(r.label, r.n_long, r.passes) for r in A.requirements(members, keys, 55, 1, 100).collect()} == {(0, 1, True), (1, 1, False), (2, 1, True)}
    assert {r.contig_idx: r.part for r in A.split_by_size(members, 500, 100).collect()} == {1: "cluster", 2: "cluster", 3: "cluster", 4: "large", 5: "single", 6: "outlier", 7: "large"}


def test_labels(members, spark):
    assert {r.contig_idx: r.dense_label for r in A.dense_labels(members).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: None, 6: None, 7: 2}
    two = spark.createDataFrame([(7, 10), (7, 11), (3, 12), (None, 13)], "label int, contig_idx long")
    one = members.select("label", "contig_idx")
    assert {(r.label, r.contig_idx) for r in A.merge_clusterings(one, two).collect()} == {(0, 1), (1, 2), (1, 3), (2, 4), (2, 7), (4, 10), (4, 11), (3, 12), (None, 13)}
    appended = {(r.label, r.contig_idx) for r in A.append_clusters(one, two).collect()}
    assert (None, 5) in appended and (None, 13) not in appended and (4, 10) in appended
    assert {(r.label, r.contig_idx) for r in A.append_clusters(one.limit(0), two).collect()} == {(2, 10), (2, 11), (1, 12)}
    supers = spark.createDataFrame([(0, 5), (2, 5)], "label int, super_label int")
    assert {(r.merged_label, r.contig_idx) for r in A.merge_by_super_clusters(one, supers).collect()} == {(0, 1), (0, 4), (0, 7), (1, 2), (1, 3)}


def test_names_and_decisions(spark):
    rows = [(1, 10, None), (2, 5000, None), (3, 900, 4), (4, 900, None), (5, 7000, None), (6, None, 4), (7, 7000, 4)]
    df = spark.createDataFrame(rows, "contig_idx long, contig_len long, label int")
    names = {r.contig_idx: r.bin for r in A.bin_names(df, 100, 3000).collect()}
    assert names == {1: "bin_small_unbinned", 2: "bin_single_contig_1", 3: "bin_4", 4: "bin_unbinned", 5: "bin_single_contig_2", 6: "bin_small_unbinned", 7: "bin_4"}
    back = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 1), ("c", 1, 1), ("c", 2, 2)], "bin string, label int, contig_idx long")
    first = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2), ("d", 2)], "bin string, n_contigs long")
    assert {tuple(r) for r in A.refine_decision(back, first, 0).collect()} == {("a", False), ("b", True), ("c", True), ("d", False)}
    assert A.adaptive_k(30, 10) == 10 and A.adaptive_k(1000, 10) == 10 and A.adaptive_k(12, 10) == 6
    assert [A.embedding_dims(n) for n in (1, 8, 60)] == [2, 4, 10]


def test_grid_choice(spark):
    rows = [(2, 5, float("nan")), (3, 5, 0.7), (2, 6, 0.7), (4, 9, None)]
    best = A.best_of_grid(spark.createDataFrame(rows, "min_cluster_size int, min_samples int, score double")).first()
    assert (best.min_cluster_size, best.min_samples, best.score) == (2, 6, 0.7)
