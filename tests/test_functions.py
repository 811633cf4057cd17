import math
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import distances as D
from seqloom.functions import sequences as S
from seqloom.operators import blocks as B


def test_dictionary():
    names, canon = S.dictionary()
    assert len(names) == 136 and list(names) == sorted(names) and canon.max() == 135
    assert names[canon[0]] == "AAAA" and names[canon[255]] == "AAAA"


def flip(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ACGTNacgté", max_size=30)), max_size=5))
def test_kmer_counts_equal_a_plain_count(texts):
    names = S.dictionary()[0]
    got = S.count_kmers(pa.array([t or "" for t in texts], pa.string()))
    for row, t in zip(got, texts, strict=True):
        t = (t or "").upper().replace("É", "?")
        words = [t[i : i + 4] for i in range(len(t) - 3)]
        words = [min(w, flip(w)) for w in words if set(w) <= set("ACGT")]
        assert {n: c for n, c in zip(names, row, strict=True) if c} == {w: words.count(w) for w in words}


def test_sequence_columns(spark):
    df = spark.createDataFrame([("ac\r\ngtU-n",), ("",), (None,)], "s string")
    rows = df.select(S.normalised(F.col("s")), S.reverse_complement(S.only_bases(F.col("s")))).collect()
    assert [tuple(r) for r in rows] == [("ACGTNNN", "ACGT"), ("", ""), (None, None)]


def test_frequencies_and_ratio(spark):
    df = spark.createDataFrame([([1, 3], [1.0, 3.0]), ([0, 0], [0.0, 4.0]), (None, None), ([], [])], "c array<long>, f array<double>")
    rows = df.select(S.frequencies(F.col("c")).alias("q"), S.log_ratio(F.col("f")).alias("r"), S.log_ratio(F.col("f"), 1.0).alias("p")).collect()
    assert rows[0].q == [0.25, 0.75] and rows[1].q is None and rows[2].q is None and rows[3].q is None
    assert rows[0].r == [math.log(0.5), math.log(1.5)] and rows[1].r == [-math.inf, math.log(2)] and rows[2].r is None and rows[3].r is None
    assert rows[1].p == pytest.approx([math.log(1 / 3), math.log(5 / 3)])


def test_sketch_is_a_sample_of_the_kmers(spark):
    rng = np.random.default_rng(1)
    seq = "".join(rng.choice(list("ACGT"), 4000))
    df = spark.createDataFrame([(1, seq), (2, flip(seq)), (3, "ACGT"), (4, None), (5, seq + "N" + seq)], "id long, s string")
    got = {r.id: r for r in S.scaled_sketch(df, "id", "s").collect()}
    assert got[1].hashes == got[2].hashes == got[5].hashes and 300 < len(got[1].hashes) < 500 and got[1].n_kmers == 3970
    assert got[3].hashes == [] and not got[4].hashes


def plain_sketch(seq, k, scale):
    """Letter by letter: canonical words as numbers of base four, mixed with Python's whole numbers."""
    out, n = set(), 0
    for i in range(len(seq) - k + 1):
        w = seq[i : i + k]
        if set(w) <= set("ACGT"):
            n += 1
            h = min(sum("ACGT".index(x) * 4 ** (k - 1 - j) for j, x in enumerate(v)) for v in (w, flip(w)))
            h = h * S.MIX_A % 2**64
            h = (h ^ (h >> 32)) * S.MIX_B % 2**64
            h ^= h >> 29
            out |= {h - (h >> 63 << 64)} if h >> 1 < scale * 2**63 else set()
    return n, sorted(out)


@pytest.mark.parametrize("k", [5, 21, 31])
def test_sketch_equals_the_plain_one_across_windows(spark, monkeypatch, k):
    monkeypatch.setattr(S, "WINDOWS", 50)
    rng = np.random.default_rng(k)
    seq = "".join(rng.choice(list("ACGTN"), 700, p=[0.245] * 4 + [0.02]))
    n, hashes = S.sketch_of(np.frombuffer(seq.encode(), np.uint8), k, 0.3)
    assert (n, hashes.tolist()) == plain_sketch(seq, k, 0.3)


def test_long_words_are_hashed_alike_on_both_strands():
    seq = "".join(np.random.default_rng(2).choice(list("ACGT"), 900))
    one, two = (S.sketch_of(np.frombuffer(x.encode(), np.uint8), 45, 0.5) for x in (seq, flip(seq)))
    assert one[0] == 856 and (one[1] == two[1]).all() and 380 < len(one[1]) < 480


def test_sketching_takes_time_in_proportion_to_the_length():
    data = np.frombuffer(b"ACGTTGCAAC", np.uint8)
    took = []
    for n in (100_000, 400_000):
        began = time.perf_counter()
        S.sketch_of(np.tile(data, n), 31, 0.1)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * max(took[0], 0.05)


# fixed values: worked by hand from the formulas; mean and variance of a and b, strict result, symmetric result
PAIRS = [
    ((5, 2), (5, 2), 1.0, D.FLOOR), ((5, 2), (7, 2), 0.5204998668282648, 0.5204998668282648), ((7, 2), (5, 2), 1.0, 0.5204998668282648),
    ((5, 2), (7, 9), 0.4563040517174124, 0.4563040517174124), ((7, 9), (5, 2), 0.4563040517174124, 0.4563040517174124), ((0, 0), (0, 0), 1.0, 1.0),
    ((7, 0.2), (5, 0.5), 1.0, None), ((5, 2), (5, 9), 1.0, None),
]


@pytest.mark.parametrize("strict", [True, False])
def test_coverage_distance(spark, strict):
    rows = [(i, *map(float, (*a, *b))) for i, (a, b, _, _) in enumerate(PAIRS)]
    df = D.with_overlap_area(spark.createDataFrame(rows, "i int, ma double, va double, mb double, vb double"), "ma", "va", "mb", "vb", strict=strict)
    got = {r.i: r.d for r in df.groupBy("i").agg(D.coverage_distance(F.col("area")).alias("d")).collect()}
    for i, (a, b, plain, kind) in enumerate(PAIRS):
        want = plain if strict else kind
        tile = B.coverage(np.array([a], float), np.array([b], float), strict)[0, 0]
        assert tile == pytest.approx(got[i], abs=1e-9)
        if want is not None:
            assert got[i] == pytest.approx(want, abs=1e-9)


def test_coverage_distance_of_several_samples(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0, 7.0, 2.0), (1, 5.0, 2.0, 7.0, 9.0), (1, 0.0, 0.0, 0.0, 0.0), (1, None, 1.0, 2.0, 1.0)], "i int, ma double, va double, mb double, vb double")
    got = D.with_overlap_area(df, "ma", "va", "mb", "vb").agg(D.coverage_distance(F.col("area")).alias("d")).first().d
    assert got == pytest.approx(math.sqrt(0.5204998668282648 * 0.4563040517174124))


def test_normal_cdf(spark):
    x = [-40.0, -9.0, -7.08, -3.3, -0.1, 0.0, 0.4, 7.0, 7.2, 38.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = [r[0] for r in df.select(D.normal_cdf(F.col("x"), F.abs("x"))).collect()]
    want = [0.5 * math.erfc(-v / math.sqrt(2)) for v in x]
    assert got == pytest.approx(want, abs=1e-15) and B.normal_cdf(np.array(x)).tolist() == pytest.approx(want, abs=1e-15)


def test_proportionality_and_euclidean(spark):
    cases = [([1.0, 2, 4, 3], [2.0, 2, 5, 1], 0.2142857142857143), ([1.0, 2, 4, 3], [1.0, 2, 4, 3], 0.0), ([1.0, 2, 1, 2], [1.0, 1, 2, 2], 1.0), ([3.0, 3], [5.0, 5], 0.0), ([math.nan, 1.0], [1.0, 2.0], 1.0)]
    df = spark.createDataFrame([(i, list(map(float, x)), list(map(float, y))) for i, (x, y, _) in enumerate(cases)] + [(9, None, [1.0]), (10, [1.0], [1.0, 2.0])], "i int, x array<double>, y array<double>")
    got = {r.i: r for r in df.select("i", D.proportionality(F.col("x"), F.col("y")).alias("p"), D.euclidean(F.col("x"), F.col("y")).alias("e")).collect()}
    for i, (x, y, want) in enumerate(cases):
        assert got[i].p == pytest.approx(want)
        assert B.proportional(np.array([x]), np.array([y]))[0, 0] == pytest.approx(want)
    assert got[9].p is None and got[9].e is None and got[10].p is None and got[10].e is None
    assert got[0].e == pytest.approx(math.sqrt(6))


def test_sketch_metrics(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 3, 4), (2, 2, 4), (0, 0, 3)], "c long, a int, b int")
    rows = df.select(*(v.alias(k) for k, v in D.sketch_metrics(F.col("c"), F.col("a"), F.col("b")).items())).collect()
    assert (rows[0].jaccard, rows[0].min_jaccard, rows[0].containment) == (1.0, 1.0, 0.0)
    assert (rows[1].jaccard, rows[1].mash_distance, rows[1].sketch_distance) == (0.0, 1.0, 1.0)
    assert (rows[2].jaccard, rows[2].min_jaccard, rows[2].sketch_distance) == (0.5, 1.0, 0.0)
    assert rows[3].min_jaccard is None and rows[3].sketch_distance == 1.0
    assert rows[2].mash_distance == pytest.approx(-math.log(2 * 0.5 / 1.5) / 31)


def test_percentage(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 50.0, 100.0, None)], "x double")
    assert [r[0] for r in df.select(D.percentage(F.col("x"))).collect()] == [0.0, 0.5, 0.01, 0.5, 1.0, None]
    with pytest.raises(Exception, match="not a percentage"):
        df.select(D.percentage(F.col("x") + 1)).collect()
