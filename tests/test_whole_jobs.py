"""Queries that take their whole tables, on planted rows that a cut by run, label or date would lose."""

import datetime as dt

import numpy as np
import pytest

from seqloom.operators import blocks as B
from seqloom.plans import relational, vectors


@pytest.fixture
def tables(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


MEMBERS = "run_id int, label int, contig_idx long, contig_len long, assigned_at timestamp_ntz"
AT = dt.datetime(2024, 1, 1)


def test_refine_decision_takes_every_run_and_label(spark, tables):
    # (run, label): indices; one index modulo three is a bin that stays whole
    bins = {(1, 0): [0, 1, 2], (1, 58): [3, 6], (1, 100): [4, 5], (2, 58): [3, 4], (3, 7): [9]}
    rows = [(run, label, i, 10, AT) for (run, label), members in bins.items() for i in members] + [(2, None, 8, 10, AT)]
    d = tables("membership", rows, MEMBERS)
    got = {(r.run_id, r.label): r.changed for r in relational.refine_decision(spark, d).collect()}
    assert got == {k: len({i % 3 for i in members}) > 1 for k, members in bins.items()}


def test_missing_samples_sees_coverage_of_any_date(spark, tables):
    tables("samples", [("s1",), ("s2",), ("x/s3.bam",), ("s4",)], "sample_name string")
    rows = [("s1", dt.datetime(2023, 11, 4)), ("s2", dt.datetime(2023, 11, 5)), ("s3", dt.datetime(2030, 1, 1)), (None, AT)]
    d = tables("coverage", rows, "sample_name string, measured_at timestamp_ntz")
    assert [r.sample_name for r in relational.missing_samples(spark, d).collect()] == ["s4"]


def planted_runs(tables):
    """Two runs of the same six contigs in other bins; label 5 holds contigs in both runs."""
    bins = {(1, 5): [0, 1], (1, 6): [2, 3], (1, 7): [4], (2, 5): [0, 2, 4], (2, 6): [1, 3]}
    rows = [(run, label, i, 600_000, AT) for (run, label), members in bins.items() for i in members] + [(2, None, 5, 50_000, AT), (1, None, 5, 50_000, AT)]
    tables("membership", rows, MEMBERS)
    tables("contigs", [(i, f"c{i} x", 50_000 if i == 5 else 600_000) for i in range(6)], "contig_idx long, contig string, contig_len long")
    freqs = [[float((i * k) % 7 + 1) for k in range(136)] for i in range(6)]
    d = tables("tnf_vec", [(i, f"c{i} x", f) for i, f in enumerate(freqs)], "contig_idx long, contig string, freqs array<double>")
    return bins, freqs, d


def test_labelled_queries_take_every_run(spark, tables):
    bins, freqs, d = planted_runs(tables)
    merged = {}
    for r in relational.super_merge(spark, d).collect():
        merged.setdefault((r.run_id, r.merged_label), set()).add(r.contig_idx)
    # labels 5 and 6 have remainders 0 and 1 modulo 5, label 7 stays alone behind them
    assert merged == {(1, 0): {0, 1}, (1, 1): {2, 3}, (1, 2): {4}, (2, 0): {0, 2, 4}, (2, 1): {1, 3}}
    part = {(r.run_id, r.contig_idx): r.part for r in relational.split_large(spark, d).collect()}
    assert part == {(run, i): "large" if len(m) > 1 else "cluster" for (run, _), m in bins.items() for i in m} | {(1, 5): "single", (2, 5): "single"}
    names = {(r.run_id, r.contig_idx): r.bin for r in relational.bin_naming(spark, d).collect()}
    assert names == {(run, i): f"bin_{label}" for (run, label), m in bins.items() for i in m} | {(1, 5): "bin_single_contig_1", (2, 5): "bin_single_contig_1"}
    means = {(r.run_id, r.label): (r.n, r.mean_distance) for r in vectors.bin_metrics_tnf(spark, d).collect()}
    kernel = B.proportional(np.array(freqs), np.array(freqs))
    assert means.keys() == bins.keys()
    for k, (n, mean) in means.items():
        # a single contig has no mean
        assert n == 1 and mean is None if len(bins[k]) == 1 else n == len(bins[k]) and mean == pytest.approx(np.mean([kernel[i, j] for i in bins[k] for j in bins[k] if i < j]), abs=1e-6)


def test_hub_distances_take_every_run(spark, tables):
    bins, freqs, d = planted_runs(tables)
    rows = [(f"c{i} x", 600_000, s, float(10 + 5 * i), 4.0, AT, AT, i) for i in range(6) for s in ("a", "b")]
    tables("coverage", rows, "contig string, contig_len long, sample_name string, mean_depth double, var_depth double, received_at timestamp_ntz, measured_at timestamp_ntz, cov_id long")
    want = {(run, i, min(m)) for (run, _), m in bins.items() for i in m if i != min(m)}
    tnf, depth = (f(spark, d).collect() for f in (vectors.tnf_distance_pairs, vectors.depth_distance_pairs))
    assert {(r.run_id, r.contig_idx, r.hub) for r in tnf} == want and len(tnf) == len(want)
    assert {(r.run_id, r.contig_idx, r.hub) for r in depth} == want and len(depth) == len(want)
    assert all(r.euclidean == pytest.approx(np.linalg.norm(np.subtract(freqs[r.contig_idx], freqs[r.hub])), abs=1e-6) for r in tnf)
    assert all(0 < r.distance <= 1 for r in depth)
