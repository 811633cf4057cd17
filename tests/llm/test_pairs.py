from seqloom.llm import queries


def test_pairs_below_a_tenth_are_counted(spark, tmp_path):
    sets = {1: list(range(40)), 2: [39, *range(100, 140)], 3: [*range(5, 30), 5], 4: [500], 5: None}
    spark.createDataFrame(list(sets.items()), "contig_idx long, hashes array<long>").write.parquet(str(tmp_path / "sketch.parquet"))
    got = {(r.contig_a, r.contig_b): (r.common_hashes, r.n_a, r.n_b, r.jaccard, r.containment) for r in queries.p3_pairs(spark, str(tmp_path)).collect()}
    assert got == {(1, 2): (1, 40, 41, 1 / 80, 1 / 40), (1, 3): (25, 40, 25, 25 / 40, 1.0)}
