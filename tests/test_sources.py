import gzip

import pytest
from pyspark.sql import functions as F

from seqloom.operators.tables import long_coverage
from seqloom.sources import sequences as Q
from seqloom.sources import sinks
from seqloom.sources import tables as T
from seqloom.streaming import incremental as I


def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fna"
    path.write_bytes(b">one first record\r\nACgt\r\nNNac\r\n>two\r\nTGTAATC\r\n>three\r\n\r\n>four\r\nACG")
    rows = Q.read_contigs(spark, str(path)).orderBy("contig_idx").collect()
    assert [(r.contig_idx, r.contig, r.seq) for r in rows] == [(0, "one", "ACGTNNAC"), (1, "two", "TGTAATC"), (2, "three", ""), (3, "four", "ACG")]
    assert [r.contig for r in Q.read_contigs(spark, str(path), 7).orderBy("contig_idx").collect()] == ["one", "two"]
    assert Q.read_fasta(spark, str(path)).where("contig = 'one'").first().description == "first record"


def test_fasta_named_fq_and_gzip(spark, tmp_path):
    (tmp_path / "x.fq").write_text(">1\nACGT\n")
    with gzip.open(tmp_path / "y.fna.gz", "wt") as f:
        f.write(">2\nGGGG\n")
    assert Q.read_contigs(spark, str(tmp_path / "x.fq")).first().seq == "ACGT"
    assert Q.read_contigs(spark, str(tmp_path / "y.fna.gz")).first().seq == "GGGG"


def test_fastq(spark, tmp_path):
    path = tmp_path / "r.fa"
    path.write_bytes(b"@r1 x\r\nACGT\r\n+\r\n@III\r\n@r2\r\nGGn\r\n+r2\r\nIII\r\n")
    assert [(r.contig, r.seq) for r in Q.read_contigs(spark, str(path)).orderBy("contig_idx").collect()] == [("r1", "ACGT"), ("r2", "GGN")]


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.fna").write_text("")
    assert Q.read_contigs(spark, str(tmp_path / "e.fna")).count() == 0


def test_coverage_round_trip(spark, tmp_path):
    rows = [("k1", 10, "a.b", 1.2345, 2.0), ("k1", 10, "c", 3.0, 0.5), ("k2", 5, "c", 4.0, 1.0)]
    long = spark.createDataFrame(rows, "contig string, contig_len long, sample_name string, mean double, var double")
    sinks.write_coverage(long, ["a.b", "c"], str(tmp_path / "cov"))
    got = {(r.contig, r.sample_name): (r.contig_len, r["mean"], r["var"]) for r in T.read_coverage(spark, str(tmp_path / "cov")).collect()}
    assert got[("k1", "a.b")] == (10, pytest.approx(1.2345, abs=6e-4), 2.0) and got[("k2", "a.b")] == (5, 0.0, 0.0) and got[("k2", "c")] == (5, 4.0, 1.0)


def test_long_read_coverage(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("Contig\tLength\tp/x.bam Mean\tx Variance\tLength2\ty Mean\ty Variance\nk\t9\t1\t2\t9\t3\t4\n")
    (tmp_path / "one.tsv").write_text("Contig\tLength\tx Mean\tx Variance\nk\t9\t1\t2\n")
    assert {(r.sample_name, r["mean"], r["var"]) for r in T.read_long_read_coverage(spark, str(tmp_path / "l.tsv")).collect()} == {("x", 1.0, 2.0), ("y", 3.0, 4.0)}
    assert T.read_long_read_coverage(spark, str(tmp_path / "one.tsv")).count() == 1


def test_kmers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("k", [0.25, 0.75]), ("m", [1.0, None])], "contig string, freqs array<double>")
    sinks.write_kmers(df, str(tmp_path / "k"), 2)
    assert {(r.contig, tuple(r.freqs)) for r in T.read_kmers(spark, str(tmp_path / "k")).collect()} == {("k", (0.25, 0.75)), ("m", (1.0, None))}


def test_clusters(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"0":[3,9],"1":[0,1,2]}')
    (tmp_path / "bad.json").write_text("{broken")
    assert {tuple(r) for r in T.read_clusters(spark, str(tmp_path / "c.json")).collect()} == {(0, 3), (0, 9), (1, 0), (1, 1), (1, 2)}
    assert T.read_clusters(spark, str(tmp_path / "bad.json")).count() == 0
    assert T.read_lines(spark, str(tmp_path / "c.json")).count() == 1


def test_manifest(spark):
    rows = T.manifest(spark, ["a/1.fq"], ["a/2.fq"], coupled=["c1", "c2"], long_bam=["l.bam"]).collect()
    assert {tuple(r) for r in rows} == {("1.fq", "paired", "a/1.fq", "a/2.fq"), ("c1", "coupled", "c1", "c2"), ("l.bam", "long_bam", "l.bam", None)}
    for wrong in ({"read1": ["x"]}, {"coupled": ["x"]}, {"other": ["x"]}, {}):
        with pytest.raises(ValueError):
            T.manifest(spark, **wrong)


def test_bins_round_trip_and_publish(spark, tmp_path):
    df = spark.createDataFrame([("b1", 1, "k1", "ACGT"), ("b1", 2, "k2", "GG"), ("b2", 3, "k3", None)], "bin string, contig_idx long, contig string, seq string")
    out, target = str(tmp_path / "staged"), str(tmp_path / "bins")
    sinks.write_bins(df, out)
    with pytest.raises(FileExistsError):
        sinks.write_bins(df, out)
    sinks.publish(spark, [out, str(tmp_path / "none")], target)
    assert sorted(p.name for p in (tmp_path / "bins").iterdir() if p.suffix != ".crc") == ["b1.fna", "b2.fna"]
    back = Q.read_bins(spark, target).collect()
    assert {(r.bin, r.contig, r.seq) for r in back} == {("b1", "k1", "ACGT"), ("b1", "k2", "GG"), ("b2", "k3", "")}
    sinks.write_bins(df.where("bin = 'b2'"), out)
    sinks.publish(spark, [out], target)
    assert {r.bin for r in Q.read_bins(spark, target).collect()} == {"b2"}


def test_a_bin_of_several_files_is_read_as_one(spark, tmp_path):
    rows = [("a b:c+", i, f"k{i}", "ACGT" * 5) for i in range(40)] + [("small", 99, "x", "A")]
    out, target = str(tmp_path / "staged"), str(tmp_path / "bins")
    # parts as small as these would share a task
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.write_bins(spark.createDataFrame(rows, "bin string, contig_idx long, contig string, seq string"), out, part_bytes=50)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sinks.publish(spark, [out], target)
    assert (tmp_path / "bins" / "a b%3Ac+.fna").is_dir() and (tmp_path / "bins" / "small.fna").is_file()
    back = Q.read_bins(spark, target).collect()
    assert sorted((r.bin, r.contig, r.seq) for r in back) == sorted((b, c, s) for b, _, c, s in rows)
    files = [str(p) for p in (tmp_path / "bins").rglob("*.fna") if p.is_file()]
    assert Q.read_bins(spark, files).count() == 41


def test_publishing_fails_before_it_deletes(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("b1", 1, "k1", "ACGT")], "bin string, contig_idx long, contig string, seq string")
    out, target = str(tmp_path / "staged"), str(tmp_path / "bins")
    sinks.write_bins(df, out)
    sinks.publish(spark, [out], target)
    sinks.write_bins(df.withColumn("bin", F.lit("b2")), out)
    with monkeypatch.context() as m:
        m.setattr(sinks, "_move", lambda fs, a, b: (_ for _ in ()).throw(OSError("no")))
        with pytest.raises(OSError):
            sinks.publish(spark, [out], target)
    assert {r.bin for r in Q.read_bins(spark, target).collect()} == {"b1"} and list((tmp_path / "staged").rglob("part-*"))
    with pytest.raises(ValueError):
        sinks.publish(spark, [str(tmp_path / "none")], target)
    assert Q.read_bins(spark, target).count() == 1


def test_no_bins_are_an_error(spark, tmp_path):
    (tmp_path / "y.txt").write_text(">b\nAC\n")
    with pytest.raises(ValueError):
        Q.read_bins(spark, str(tmp_path))


def test_every_file_is_read_by_its_own_kind(spark, tmp_path):
    (tmp_path / "a.fq").write_text("\n>x wrapped\nACGT\nGGGG\r\nTTTT\n>y\nAC\n")
    (tmp_path / "b.fna").write_text("@r\nACG\n+\nIII\n@s\nGG\n+\n@I\n")
    (tmp_path / "c.fna").write_text("")
    with gzip.open(tmp_path / "d.fq.gz", "wt") as f:
        f.write("@z\nTT\n+\nII\n")
    got = {r.contig: r.seq for r in Q.read_contigs(spark, str(tmp_path)).collect()}
    assert got == {"x": "ACGTGGGGTTTT", "y": "AC", "r": "ACG", "s": "GG", "z": "TT"}
    assert [r.contig_idx for r in Q.read_contigs(spark, str(tmp_path)).orderBy("contig_idx").collect()] == [0, 1, 2, 3, 4]


def test_bins_by_file(spark, tmp_path):
    (tmp_path / "x.1.fna").write_text(">a\nAC\n")
    (tmp_path / "y.txt").write_text(">b\nAC\n")
    assert [tuple(r) for r in Q.read_bins(spark, str(tmp_path)).collect()] == [("x.1", "a", "AC", 2)]


def test_metrics_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3, 0.1, 0.2, 0.3, 0.4)], "label int, n_contigs long, bin_size long, cov_dist double, tnf_dist double, sketch_dist double, embed_dist double")
    sinks.write_metrics(df, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0].split("\t") == ["1", "2", "3", "0.1", "0.2", "0.3", "0.4"]


def test_coverage_stream_keeps_the_last_received(spark, tmp_path):
    schema = "cov_id long, contig string, contig_len long, sample_name string, mean_depth double, var_depth double, measured_at timestamp_ntz, received_at string"
    parts = [[(1, "k", 1, "s", 1.0, 1.0, None, "2024-01-02")], [(2, "k", 1, "s", 2.0, 1.0, None, "2024-01-01"), (3, "m", 1, "s", 3.0, 1.0, None, "2024-01-05")]]
    table = I.VersionedTable(spark, str(tmp_path / "kept"))
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        rows = stream.select("contig", "sample_name", F.col("mean_depth").alias("mean"), F.col("var_depth").alias("var"), "received_at", "cov_id")
        I.merge_coverage_stream(rows, table, str(tmp_path / "at")).awaitTermination()
    assert {(r.contig, r["mean"]) for r in table.read().collect()} == {("k", 1.0), ("m", 3.0)}
    assert len(table.versions()) == 2 and long_coverage(spark.read.parquet(str(tmp_path / "in"))).count() == 2


def test_orphan_stream(spark, tmp_path):
    schema = "key string, refs int, alive int"
    table = I.VersionedTable(spark, str(tmp_path / "kept"))
    for part in ([("a", 1, 0), ("b", 1, 1)], [("a", 0, 1), ("b", 0, -1)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        I.orphan_count_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, str(tmp_path / "at")).awaitTermination()
    assert {tuple(r) for r in table.read().collect()} == {("a", 1, 1), ("b", 1, 0)}
