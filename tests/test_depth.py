import gzip
import random
import re
import struct

import numpy as np
import pytest

from seqloom.operators import depth as D
from seqloom.operators import tables as T


def plain_depth(rows, lengths):
    out = {c: np.zeros(n or 0) for c, n in lengths.items()}
    for contig, start, cigar in rows:
        if contig not in out or start is None or cigar is None:
            continue
        at = start
        for n, x in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
            if x in "M=X":
                out[contig][max(at, 0) : max(at + int(n), 0)] += 1
            at += int(n) * (x in "M=XDN")
    return out


def test_coverage_equals_counting_every_base(spark, monkeypatch):
    monkeypatch.setattr(D, "STRETCH", 16)
    rng = random.Random(1)
    lengths = {"a": 120, "b": 40, "c": 9, "d": 1, "none": None, "zero": 0}
    rows = [(rng.choice(["a", "a", "b", "d", "other", None]), rng.randrange(-3, 118), rng.choice(["10M", "3S4M2D5M", "2M1I3=4X", "*", "5M30N5M", None])) for _ in range(200)]
    contigs = spark.createDataFrame(list(lengths.items()), "contig string, contig_len long")
    got = {r.contig: r for r in D.coverage_of(spark.createDataFrame(rows, "contig string, start long, cigar string"), contigs).collect()}
    want = plain_depth(rows, lengths)
    for c in "abcd":
        assert got[c]["mean"] == pytest.approx(want[c].mean())
        assert got[c]["var"] == pytest.approx(want[c].var(ddof=1) if lengths[c] > 1 else 0)
    assert got["none"]["mean"] is None and got["zero"]["mean"] is None


def test_sam(spark, tmp_path):
    line = "r\t{}\tk\t3\t60\t4M\t*\t0\t0\tACGT\tIIII"
    (tmp_path / "x.sam").write_text("@SQ\tSN:k\tLN:9\n" + "\n".join(line.format(f) for f in (0, 4, 256, 16)) + "\n")
    rows = D.read_sam(spark, str(tmp_path / "x.sam")).collect()
    assert [tuple(r) for r in rows] == [("k", 2, "4M")] * 2


def packed(name, ops, ref, start, flag=0):
    head = struct.pack("<iiBBHHHiiii", ref, start, len(name) + 1, 60, 0, len(ops), flag, 0, -1, -1, 0)
    body = head + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | D.CIGAR.index(x)) for n, x in ops)
    return struct.pack("<i", len(body)) + body


def test_bam_is_read_in_blocks_and_completes_a_table(spark, tmp_path):
    refs = [("a", 50), ("b", 20)]
    head = b"BAM\1" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in refs)
    reads = [packed("r1", [(10, "M")], 0, 5), packed("r2", [(3, "S"), (4, "M"), (2, "D"), (1, "=")], 0, 8), packed("r3", [(5, "M")], -1, -1, 4), packed("r4", [(20, "M")], 1, 0), packed("r5", [(9, "M")], 1, 0, 0x100)]
    raw = head + b"".join(reads)
    # blocked gzip is a row of gzip members; records lie across their ends
    (tmp_path / "s1.bam").write_bytes(b"".join(gzip.compress(raw[i : i + 37]) for i in range(0, len(raw), 37)) + gzip.compress(b""))
    got = sorted((r.contig, r.start, r.cigar) for r in D.read_bam(spark, [str(tmp_path / "s1.bam")]).collect())
    assert got == [("a", 5, "10M"), ("a", 8, "3S4M2D1="), ("b", 0, "20M")]
    contigs = spark.createDataFrame([("a", 50), ("b", 20)], "contig string, contig_len long")
    files = spark.createDataFrame([("x/s1.bam", "short_bam", str(tmp_path / "s1.bam")), ("old.bam", "short_bam", "nowhere.bam")], "sample_name string, kind string, path1 string")
    done = spark.createDataFrame([("a", 50, "old", 7.0, 1.0)], "contig string, contig_len long, sample_name string, mean double, var double")
    rows = {(r.contig, r.sample_name): r["mean"] for r in T.complete(files, done, lambda lacking: D.sample_coverage(spark, lacking, contigs)).collect()}
    assert rows == {("a", "old"): 7.0, ("a", "s1"): 15 / 50, ("b", "s1"): 1.0}
    (tmp_path / "bad.bam").write_bytes(gzip.compress(raw[:-3]))
    with pytest.raises(Exception, match="ends within"):
        D.read_bam(spark, [str(tmp_path / "bad.bam")]).collect()
