import numpy as np
from pyspark.sql import functions as F

from seqloom import __main__ as M
from seqloom.plans import recover as R


def test_refine_splits_genomes_of_equal_depth_by_composition(spark):
    rng = np.random.default_rng(8)
    contigs, coverage = [], []
    for i in range(40):
        p = np.array([(4, 1, 1, 4), (1, 4, 4, 1)][i % 2]) / 10
        contigs.append((i, f"c{i}", "".join(rng.choice(list("ACGT"), 2500, p=p)), 2500))
        coverage += [(f"c{i}", s, float(rng.normal(20, 0.3)), 2.0) for s in "xy"]
    contigs.append((40, "n", "N" * 2500, 2500))
    coverage.append(("n", "x", 20.0, 2.0))
    rows = spark.createDataFrame(contigs, "contig_idx long, contig string, seq string, contig_len long")
    depths = spark.createDataFrame(coverage, "contig string, sample_name string, mean double, var double")
    vectors = M.bin_vectors(rows, depths, ["x", "y"]).cache()
    assert {(len(r.vec), all(np.isfinite(r.vec))) for r in vectors.collect()} == {(138, True)} and vectors.count() == 41
    bins = rows.where("contig_idx < 40").select("contig_idx", "contig_len", F.lit("bin_1").alias("bin"))
    options = R.Options(min_contig_size=1000, min_bin_size=20_000, min_contig_count=3)
    of = {r.contig_idx: r.bin for r in R.refine(bins, vectors, options).collect()}
    binned = {i: b for i, b in of.items() if "unbinned" not in b}
    assert len(binned) >= 30 and {i % 2 for i in binned} == {0, 1}
    assert all(len({i % 2 for i, x in binned.items() if x == b}) == 1 for b in binned.values())
