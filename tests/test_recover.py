import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.plans import recover as R


@pytest.fixture(scope="module")
def assembly(spark):
    """Three genomes with their own depths and base composition, and short leftovers."""
    rng = np.random.default_rng(11)
    contigs, coverage = [], []
    for g, (weights, depth) in enumerate([((4, 1, 1, 4), (30, 5)), ((1, 4, 4, 1), (6, 25)), ((1, 3, 1, 3), (15, 60))]):
        p = np.array(weights) / sum(weights)
        for _ in range(25):
            i = len(contigs)
            contigs.append((i, f"c{i}", "".join(rng.choice(list("ACGT"), 2500, p=p)), 2500))
            coverage += [(f"c{i}", s, float(rng.normal(m, 0.6)), float(abs(rng.normal(m, 1)) + 1)) for s, m in zip("xy", depth, strict=True)]
    contigs += [(75, "short", "ACGT" * 10, 40), (76, "unmeasured", "ACGT" * 700, 2800)]
    coverage.append(("short", "x", 1.0, 1.0))
    return (
        spark.createDataFrame(contigs, "contig_idx long, contig string, seq string, contig_len long").cache(),
        spark.createDataFrame(coverage, "contig string, sample_name string, mean double, var double").cache(),
    )


OPTIONS = R.Options(min_contig_size=1000, min_bin_size=20_000, min_contig_count=3, n_neighbours=12)


def test_recover_separates_planted_genomes(spark, assembly):
    contigs, coverage = assembly
    rows = R.recover(contigs, coverage, ["x", "y"], OPTIONS).select("bin", "contig_idx").collect()
    assert sorted(r.contig_idx for r in rows) == list(range(77))
    of = {r.contig_idx: r.bin for r in rows}
    assert of[75] == "bin_small_unbinned" and of[76] == "bin_unbinned"
    for name in {b for b in of.values() if "unbinned" not in b}:
        assert len({i // 25 for i, b in of.items() if b == name}) == 1
    assert sum("unbinned" not in of[i] for i in range(75)) >= 50


def test_refine_splits_a_mixed_bin(spark, assembly):
    contigs, coverage = assembly
    vectors = R.coverage_vectors(coverage, ["x", "y"]).join(contigs, "contig").select(F.col("contig_idx").alias("id"), F.array(F.col("cov")[0], F.col("cov")[2]).alias("vec"))
    name = F.when(F.col("contig_idx") < 50, "bin_1").when(F.col("contig_idx") < 75, "bin_2").otherwise("bin_unbinned")
    bins = contigs.select("contig_idx", "contig_len", name.alias("bin"))
    rows = R.refine(bins, vectors, OPTIONS).collect()
    assert sorted(r.contig_idx for r in rows) == list(range(77))
    of = {r.contig_idx: (r.bin, r.refined) for r in rows}
    assert of[75] == ("bin_unbinned", False)
    for b in {b for b, refined in of.values() if refined and "unbinned" not in b and "_single" not in b}:
        assert len({i // 25 for i, (x, _) in of.items() if x == b}) == 1
    assert of[0][1] and of[0][0] != of[49][0]
