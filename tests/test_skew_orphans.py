import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from seqloom.operators import orphans as O
from seqloom.operators import skew as S


def test_salted_counts_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.randrange(40), rng.choice([5, 7, None]), "x") for _ in range(2000)]
    df = spark.createDataFrame(rows, "k int, id long, v long, __salt string")
    got = {r.k: (r.n_rows, r.s) for r in S.salted_aggregate(df, ["k"], {"s": "v"}, ["id"], heavy_share=0.3, salts=7).collect()}
    want = {k: (sum(r[0] == k for r in rows), sum(r[2] or 0 for r in rows if r[0] == k)) for k in {r[0] for r in rows}}
    assert got == want
    once = {r.k: (r.n_rows, r.s) for r in S.salted_aggregate(df, ["k"], {"s": F.col("v")}, ["id"], distinct=True, heavy_share=0.3).collect()}
    distinct = {r[:3] for r in rows}
    assert once == {k: (sum(r[0] == k for r in distinct), sum(r[2] or 0 for r in distinct if r[0] == k)) for k in {r[0] for r in rows}}


def test_heavy_key_is_spread_over_salts(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), "id")
    assert S.salted(df, ["k"], ["id"], 0.5, 16).select(S.SALT).distinct().count() == 16


def test_heavy_hitters(spark):
    rows = [(1,)] * 50 + [(2,)] * 5 + [(None,)] * 44 + [(3,)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "label int, id long")
    assert {tuple(r) for r in S.heavy_hitters(df, "label", ["id"], 0.05).collect()} == {(1, 50), (2, 5)}
    assert S.heavy_hitters(df.limit(0), "label", ["id"], 0.05).count() == 0


DAY = datetime(2024, 1, 1)


def at(n):
    return None if n is None else DAY + timedelta(days=n)


def plain_orphans(refs, records):
    out = Counter()
    for table, row, key, t in refs:
        if key is None:
            continue
        own = [(b, e) for k, b, e in records if k == key]
        if t is not None and any(b is not None and b <= t and (e is None or e > t) for b, e in own):
            continue
        early = t is not None and not any(b is not None and b <= t for b, _ in own)
        reason = "missing" if not own else "early" if early else "removed"
        out[(table, row, reason, None if t is None else f"{at(t):%Y-%m}")] += 1
    return out


def test_orphans_equal_brute_force(spark):
    rng = random.Random(5)
    keys = ["a", "b", "c", "hot", ""]
    day = lambda: rng.choice([None, *range(0, 90, 3)])
    records = [(rng.choice(keys[:-1]), day(), day()) for _ in range(60)]
    records += records[:5]
    refs = [(rng.choice(["x", "y"]), i, rng.choice([*keys, "hot", "hot", None, "none"]), day()) for i in range(600)]
    refs += refs[:10]
    recs = spark.createDataFrame([(k, at(b), at(e), 1) for k, b, e in records], "name string, b timestamp_ntz, e timestamp_ntz, alive int")
    df = spark.createDataFrame([(t, i, k, at(x), 0) for t, i, k, x in refs], "src_table string, row_id long, key string, at timestamp_ntz, known int")
    deltas = O.existence_deltas(recs, F.col("name"), "b", "e")
    for hot in (1_000_000, 20):
        got = Counter(tuple(r) for r in O.orphans(df, deltas, hot_rows=hot).collect())
        assert got == plain_orphans(refs, records), hot
    assert O.orphans(df.limit(0), deltas).count() == 0
    assert O.orphans(df, deltas.limit(0)).where("reason <> 'missing'").count() == 0


def test_first_token(spark):
    df = spark.createDataFrame([(" a b",), ("",), (None,), ("c\tlen=3",)], "n string")
    assert [r[0] for r in df.select(O.first_token(F.col("n"))).collect()] == ["a", "", None, "c"]


def test_signed_counts(spark):
    schema = "key string, refs int, alive int"
    one = O.apply_deltas(None, spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 1, 0), (None, 1, 0)], schema))
    assert {tuple(r) for r in O.current_orphans(one).collect()} == {("b", 1)}
    two = O.apply_deltas(one, spark.createDataFrame([("a", 0, -1), ("b", -1, 0)], schema))
    assert {tuple(r) for r in two.collect()} == {("a", 2, 0)}
    assert {tuple(r) for r in O.current_orphans(two).collect()} == {("a", 2)}
