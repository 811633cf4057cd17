"""The queries against their SQL, and those that SQL cannot express against plain versions."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from compare import canonical
from seqloom.llm import queries as Q
from seqloom.llm.tokens import DEFAULT_TOKENIZER, count

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def connected():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", list(Q.ORACLE))
def test_query_equals_its_sql(spark, name):
    df = Q.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    rows = sorted((tuple(canonical(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    rel = connected().execute(Q.ORACLE[name])
    order = sorted(range(len(rel.description)), key=lambda i: rel.description[i][0])
    assert cols == [rel.description[i][0] for i in order]
    assert rows == sorted((tuple(canonical(r[i]) for i in order) for r in rel.fetchall()), key=repr)


@pytest.fixture(scope="module")
def docs():
    """Tokens, source and text of every document."""
    rows = connected().execute("select doc_id, lower(trim(source)), text from documents").fetchall()
    return {i: (count(text, DEFAULT_TOKENIZER), source, text) for i, source, text in rows}


def test_packing_queries(spark, docs):
    rows = Q.p7_pack(spark, str(DATA)).collect()
    own, fill = {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r.n_tokens)
        if r.container_id is not None:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert {i: sum(n) for i, n in own.items()} == {i: n for i, (n, _, _) in docs.items()}
    assert all(len(n) == max(1, -(-docs[i][0] // 2048)) for i, n in own.items()) and max(fill.values()) <= 2048
    report = Q.p7_report(spark, str(DATA)).first()
    assert report.n_containers == len(fill) <= 1.05 * report.least_containers + 1 and report.n_tokens == sum(fill.values())


def test_mixing_queries(spark, docs):
    targets = {s: (w, n) for s, w, n in connected().execute("select source, target_share, max_repeats from mix_targets").fetchall()}
    total = sum(n for n, _, _ in docs.values())
    own = {s: sum(n for n, x, _ in docs.values() if x == s) for s in targets}
    short = {s for s, (w, n) in targets.items() if w * total > n * own[s]}
    assert {r.source for r in Q.p8_found(spark, str(DATA)).collect()} == short
    uses = {}
    for r in Q.p8_mix(spark, str(DATA)).collect():
        assert docs[r.doc_id][:2] == (r.n_tokens, r.source)
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
    assert all(n <= targets[docs[i][1]][1] for i, n in uses.items())
    shares = {r.source: r for r in Q.p8_shares(spark, str(DATA)).collect()}
    assert shares.keys() == targets.keys()
    assert {s: r.mix_tokens for s, r in shares.items()} == {s: sum(n * docs[i][0] for i, n in uses.items() if docs[i][1] == s) for s in targets}
    longest = {s: max([n for n, x, _ in docs.values() if x == s], default=0) for s in targets}
    for s, (w, n) in targets.items():
        assert abs(shares[s].mix_tokens - min(w * total, n * own[s])) <= longest[s]
    even = {r.source: r for r in Q.p8_even_shares(spark, str(DATA)).collect()}
    size = min(n * own[s] / w for s, (w, n) in targets.items() if n * own[s] and w)
    for s, (w, _) in targets.items():
        assert abs(even[s].mix_tokens - (w * size if own[s] else 0)) <= longest[s] and even[s].most_uses <= targets[s][1]


def test_splitting_queries(spark, docs):
    large = {i for i, (n, _, _) in docs.items() if n > 2048}
    assert {r.doc_id for r in Q.p9_found(spark, str(DATA)).collect()} == large
    pieces = {}
    for r in Q.p9_pieces(spark, str(DATA)).collect():
        assert count(r.text, DEFAULT_TOKENIZER) == r.n_tokens <= 2048
        assert docs[r.doc_id][2].encode()[r.start_byte : r.end_byte].decode() == r.text
        pieces.setdefault(r.doc_id, []).append((r.start_byte, r.end_byte))
    assert pieces.keys() == large
    for i, spans in pieces.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == len(docs[i][2].encode())
        assert all(a[0] < b[0] <= a[1] < b[1] for a, b in zip(spans, spans[1:], strict=False))


def test_clusters_describe_their_members(spark):
    con = connected()
    rows = con.execute("select distinct contig_idx, contig_len, freqs from tnf_vec where contig_len >= 1500 and len(freqs) = 136").fetchall()
    whole = {i: (n, f) for i, n, f in rows if all(v is not None and np.isfinite(v) for v in f)}
    members = {r.contig_idx: r for r in Q.p6_members(spark, str(DATA)).collect()}
    assert members.keys() == whole.keys()
    groups = {}
    for i, r in members.items():
        assert (r.cluster_key is None) == (r.density is None)
        if r.cluster_key is not None:
            groups.setdefault(r.cluster_key, []).append(i)
    found = {r.cluster_key: r for r in Q.p6_clusters(spark, str(DATA)).collect()}
    assert found.keys() == groups.keys() and groups
    for key, ids in groups.items():
        r = found[key]
        assert key == min(ids) and r.n_contigs == len(ids) >= 5 and r.bin_size == sum(whole[i][0] for i in ids)
        best = sorted(ids, key=lambda i: (-members[i].density, i))[:5]
        assert list(r.exemplars) == best
    # a stable cluster lies within one chain of contigs
    chain = {r.contig_idx: r.cluster_key for r in Q.p6_found(spark, str(DATA)).collect()}
    assert all(len({chain[i] for i in ids}) == 1 for ids in groups.values())
