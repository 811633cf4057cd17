import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import mixing, packing, splitting
from seqloom.llm.tokens import DEFAULT_TOKENIZER, PATTERN, count, encoder, safe_cuts, token_count


def words(rng, n, ends=" \n"):
    return "".join(rng.choice(["the", "hill", "Straße", "12", "don't", "end.", "(x)", "ы"]) + rng.choice(ends) for _ in range(n))


def test_pattern_is_the_published_one():
    public = pytest.importorskip("public_tokenizers")
    assert public.PATTERN == PATTERN


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab 1.'\n\té ’s日"), max_size=40))
def test_tokens_add_up_over_safe_cuts(text):
    enc = encoder(DEFAULT_TOKENIZER)[0]
    raw = text.encode()
    cuts = [0, *safe_cuts(np.frombuffer(raw, np.uint8)), len(raw)]
    parts = [enc.encode_ordinary(raw[a:b].decode()) for a, b in zip(cuts, cuts[1:])]
    assert sum(parts, []) == enc.encode_ordinary(text)


def test_counts(spark):
    text = words(random.Random(1), 300_000)
    enc = encoder(DEFAULT_TOKENIZER)[0]
    assert count(text, DEFAULT_TOKENIZER) == len(enc.encode_ordinary(text))
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(token_count(F.col("t"))).collect()] == [2, 0, 0]


def pieces_of(spark, texts, limit, overlap):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, raw string")
    out = {}
    for r in splitting.split(df, limit, overlap).collect():
        out.setdefault(r.doc_id, []).append(r)
    return {d: sorted(rs, key=lambda r: (r.range_no, r.piece_no)) for d, rs in out.items()}


def check_pieces(text, rows, limit, overlap):
    enc = encoder(DEFAULT_TOKENIZER)[0]
    raw = text.encode()
    at = 0
    for k, r in enumerate(rows):
        assert raw[r.start_byte : r.end_byte].decode() == r.text
        assert len(enc.encode_ordinary(r.text)) == r.n_tokens <= limit
        assert r.start_byte <= at < r.end_byte
        if k:
            repeated = len(enc.encode_ordinary(raw[r.start_byte : at].decode()))
            assert abs(repeated - overlap) <= 6
        at = r.end_byte
    assert at == len(raw)


def test_pieces(spark):
    rng = random.Random(2)
    texts = [words(rng, 900), words(rng, 900, " "), words(rng, 10), "", None, "日本語" * 900, "a" * 9000, words(rng, 3000, "\n"), " " * 5000 + words(rng, 500)]
    got = pieces_of(spark, texts, 200, 16)
    enc = encoder(DEFAULT_TOKENIZER)[0]
    assert set(got) == {i for i, t in enumerate(texts) if t and len(enc.encode_ordinary(t)) > 200}
    for i, rows in got.items():
        check_pieces(texts[i], rows, 200, 16)
    # lines where there are lines, words where there are only words
    assert all(r.text.endswith("\n") or texts[7].encode()[r.end_byte : r.end_byte + 1] == b"\n" for r in got[7][:-1])
    assert all(texts[1].encode()[r.end_byte : r.end_byte + 1] in (b" ", b"") or r.text.endswith(" ") for r in got[1])


def test_texts_of_several_ranges(spark):
    rng = random.Random(3)
    texts = [words(rng, 12_000), "x" * 30_000, words(rng, 3000) + "é" * 20_000]
    got = pieces_of(spark, texts, 100, 8)
    assert max(r.range_no for r in got[0]) > 2
    for i in (0, 2):
        check_pieces(texts[i], got[i], 100, 8)
    assert "".join(r.text for r in got[1])[:10] == "x" * 10 and got[1][-1].end_byte == 30_000
    starts = [r.token_start for r in got[0]]
    assert starts == sorted(starts) and starts[0] == 0


def test_limit_is_exact(spark):
    df = spark.createDataFrame([(1, " a" * 100), (2, " a" * 101), (3, None), (4, "")], "doc_id long, text string")
    assert [r.doc_id for r in splitting.oversized(df, 100, 8).collect()] == [2]
    assert splitting.split(df.limit(0), 100, 8).count() == 0


def test_files_by_ranges(spark, tmp_path):
    text = words(random.Random(4), 20_000)
    path = tmp_path / "big.txt"
    path.write_text(text)
    size, halo = splitting.sizes(100, 8, DEFAULT_TOKENIZER)
    paths = spark.createDataFrame([(7, str(path), path.stat().st_size)], "doc_id long, path string, n_bytes long")
    ranges = splitting.file_ranges(spark, paths, size, halo)
    stitched = splitting.stitch(splitting.boundary_table(ranges, 100, 8), 100)
    assert stitched.first().doc_tokens == count(text, DEFAULT_TOKENIZER)
    rows = sorted(splitting.emit(ranges, stitched, 100, 8).collect(), key=lambda r: (r.range_no, r.piece_no))
    check_pieces(text, rows, 100, 8)


# --- packing ---


def least_containers(sizes, capacity):
    """By trying everything; for a few items."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_the_optimum(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    h = packing.Histogram(dict(counts))
    fixed = packing.reduce(h, 20)
    left = [s for s, n in h.count.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + least_containers(left, 20) == least_containers(sizes, 20)
    patterns = packing.solve(counts, 20)
    used = [s for sets, n in patterns for s in sets for _ in range(n)]
    assert sorted(used) == sorted(sizes) and all(sum(s) <= 20 for s, _ in patterns)


def plain_best_fit(sizes, capacity):
    """One item after another, each into the fullest container that takes it."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - s)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_by_groups_is_best_fit_by_items(sizes):
    patterns = packing.best_fit(packing.Histogram({s: sizes.count(s) for s in sizes}), 20)
    assert sorted(20 - sum(sets) for sets, n in patterns for _ in range(n)) == plain_best_fit(sizes, 20)
    assert sorted(s for sets, n in patterns for s in sets for _ in range(n)) == sorted(sizes)


def test_pack(spark):
    rng = random.Random(5)
    sizes = [rng.choice([0, 3, 3, 3, 40, 55, 60, 99, 100, 101, 250, 700]) for _ in range(400)] + [None, -4]
    df = spark.createDataFrame([(i, s, 1) for i, s in enumerate(sizes)], "doc_id long, n long, rank int")
    rows = packing.pack(df, "doc_id", "n", 100, bucket_rows=20).collect()
    got = {}
    for r in rows:
        got.setdefault(r.item_id, []).append(r)
    assert set(got) == set(range(len(sizes)))
    for i, s in enumerate(sizes):
        s = max(s or 0, 0)
        assert sum(r.n_tokens for r in got[i]) == s and len(got[i]) == max(1, -(-s // 100))
        assert all((r.container_id is None) == (r.n_tokens == 0) for r in got[i])
    fill = {}
    for r in rows:
        if r.container_id is not None:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= 1.1 * -(-sum(fill.values()) // 100)
    assert packing.report(packing.pack(df, "doc_id", "n", 100), 100).first().n_containers == len(fill)
    assert packing.pack(df.limit(0), "doc_id", "n", 100).count() == 0


def test_hot_size(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 51L, 7L) as n")
    rows = packing.pack(df, "doc_id", "n", 100).collect()
    assert len(rows) == 3000 and len({(r.item_id, r.piece_no) for r in rows}) == 3000


# --- mixing ---

SIZED = "doc_id long, source string, n_tokens long"
TARGETS = "source string, target_share double, max_repeats int"


def test_mix(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice([0, 5, 40, 90])) for i in range(4000)]
    sized = spark.createDataFrame(docs, SIZED)
    targets = spark.createDataFrame([(" A", 0.2, 1), ("b", 0.3, 2), ("c", 0.4, 1), ("none", 0.1, 9), (None, 0.1, 1), ("b", 0.1, 5), ("zero", None, None)], TARGETS)
    budget = mixing.budgets(sized, targets).cache()
    own = {s: sum(d[2] for d in docs if d[1] == s) for s in "abc"}
    total = sum(d[2] for d in docs)
    limits = {"a": (0.2, 1), "b": (0.3, 2), "c": (0.4, 1), "none": (0.1, 9), "zero": (0.0, 0)}
    assert {r.source for r in mixing.short_sources(sized, targets).collect()} == {s for s, (w, n) in limits.items() if w * total > n * own.get(s, 0)}
    rows = mixing.mix(sized, targets).collect()
    size = {d[0]: d for d in docs}
    uses = {}
    for r in rows:
        assert size[r.doc_id][1] == r.source and size[r.doc_id][2] == r.n_tokens > 0
        uses.setdefault(r.doc_id, []).append(r.use_no)
    for d, used in uses.items():
        assert len(used) == len(set(used)) <= limits[size[d][1]][1]
    for s in "abc":
        mixed = sum(r.n_tokens for r in rows if r.source == s)
        want = min(limits[s][0] * total, limits[s][1] * own[s])
        assert abs(mixed - want) <= 0.02 * total
    shares = {r.source: r for r in mixing.shares(spark.createDataFrame(rows), budget).collect()}
    assert shares["none"].mix_tokens == 0 and shares["b"].most_uses <= 2
    assert sum(r.share_of_mix for r in shares.values()) == pytest.approx(1)


def test_slots_are_spread_evenly(spark):
    budget = spark.createDataFrame([("a", 0.5, 1, 1, 1, 50_000.0, 100_000), ("b", 0.25, 1, 1, 1, 25_000.0, 100_000), ("c", 0.25, 1, 1, 1, 25_000.0, 100_000)], "source string, target_share double, max_repeats long, own_tokens long, capacity long, target_tokens double, total_tokens long")
    rows = sorted((r.slot, r.source, r.block_no) for r in mixing.schedule(budget, 100).collect())
    assert len(rows) == 1006
    seen = {"a": 0, "b": 0, "c": 0}
    for n, (slot, source, block) in enumerate(rows, 1):
        assert slot == n - 1 and block == seen[source]
        seen[source] += 1
        assert abs(seen["a"] - n / 2) <= 3 and abs(seen["b"] - n / 4) <= 3


def test_shares_beyond_the_whole_are_all_short(spark):
    sized = spark.createDataFrame([(i, "a" if i < 60 else "b", 1000) for i in range(100)], SIZED)
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1)], TARGETS)
    assert {r.source for r in mixing.short_sources(sized, targets, 500).collect()} == {"a", "b"}
    assert sum(r.n_tokens for r in mixing.mix(sized, targets, 500).collect()) == 100_000


def test_short_sources_at_the_edge(spark):
    # targets of 30, 50 and 20 thousand tokens: one that is just enough, one a token short, one without any document
    sized = spark.createDataFrame([(1, "a", 30_000), (2, "b", 24_999), (3, "c", 44_999), (4, None, 2)], SIZED)
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 2), ("gone", 1e-6, 5)], TARGETS)
    assert {r.source for r in mixing.short_sources(sized, targets, 100).collect()} == {"b", "gone"}


def test_a_mix_of_even_shares(spark):
    sized = spark.createDataFrame([(i, "a" if i < 100 else "b", 50) for i in range(1000)], SIZED)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("gone", 0.2, 9)], TARGETS)
    plan = mixing.planned(sized, targets, 100, rule="shares")
    got = {r.source: r for r in mixing.shares(mixing.mix(sized, targets, plan=plan), plan[0]).collect()}
    assert got["a"].mix_tokens == 10_000 and got["a"].most_uses == 2 and got["gone"].mix_tokens == 0
    assert got["a"].share_of_mix == pytest.approx(0.5 / 0.8, abs=0.01) and got["b"].share_of_mix == pytest.approx(0.3 / 0.8, abs=0.01)
    with pytest.raises(ValueError):
        mixing.budgets(sized, targets, "other")


def test_empty_mixes(spark):
    sized, targets = spark.createDataFrame([(1, "a", 5)], SIZED), spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    assert mixing.mix(sized.limit(0), targets).count() == 0
    assert mixing.mix(sized, targets.limit(0)).count() == 0
    assert {r.source for r in mixing.short_sources(sized.limit(0), targets).collect()} == set()
    assert [r.doc_id for r in mixing.mix(sized, targets).collect()] == [1]
