"""Coverage of contigs from alignments, without a row per base.

An alignment covers stretches of its contig (its CIGAR without gaps). A stretch
is +1 at its start and -1 behind its end; the running sum of these signed
counts is the depth up to the next change, and mean and variance follow from
depth times length and depth squared times length.

Defined results: positions count from 0; parts of a stretch outside the contig
are cut off; alignments without a contig, a position or a CIGAR are left out;
contigs without alignments have mean and variance 0; a contig of null or no
length has neither. The variance is that of a sample of positions (over n - 1).
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator, Sequence
from itertools import batched
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.ranks import running_sum
from seqloom.session import cut

STRETCH = 1 << 16


def cigar_stretches(start: Column, cigar: Column) -> Column:
    """``array<struct<start, end>>`` of the positions that the letters M, = and X cover; D and N move on, the others do not."""
    lengths = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1))
    letters = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    steps = F.zip_with(lengths, letters, lambda n, x: F.struct(n.cast("long").alias("n"), x.alias("x")))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    empty = F.struct(start.cast("long").alias("at"), nothing.alias("parts"))

    def step(done: Column, s: Column) -> Column:
        to = done["at"] + s["n"]
        covers, moves = s["x"].isin("M", "=", "X"), s["x"].isin("M", "=", "X", "D", "N")
        part = F.array(F.struct(done["at"].alias("start"), to.alias("end")))
        return F.struct(F.when(moves, to).otherwise(done["at"]).alias("at"), F.when(covers, F.concat(done["parts"], part)).otherwise(done["parts"]).alias("parts"))

    return F.aggregate(steps, empty, step, lambda done: done["parts"])


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """``contig, start, cigar`` of the mapped primary alignments of SAM text."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where("value not like '@%'").select(cells.alias("c")).where(F.size("c") >= 11)
    flag = F.col("c")[1].cast("int")
    mapped = rows.where((flag.bitwiseAND(F.lit(UNMAPPED)) == 0) & (F.col("c")[5] != "*"))
    return mapped.select(F.col("c")[2].alias("contig"), (F.col("c")[3].cast("long") - 1).alias("start"), F.col("c")[5].alias("cigar"))


# fixed values: the operations of packed CIGARs in their order
CIGAR = "MIDNSHP=X"
UNMAPPED = 0x4 | 0x100 | 0x800


def bam_records(stream: BinaryIO) -> Iterator[tuple[str, int, str]]:
    """``contig, start, cigar`` of the mapped primary alignments of an unpacked BAM stream, read record by record."""

    def exactly(n: int) -> bytes:
        data = stream.read(n)
        if len(data) < n:
            raise ValueError("a BAM file ends within a record")
        return data

    def number() -> int:
        return struct.unpack("<i", exactly(4))[0]

    if exactly(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    exactly(number())
    names = []
    for _ in range(number()):
        names.append(exactly(number())[:-1].decode())
        number()
    while size := stream.read(4):
        body = exactly(struct.unpack("<i", size)[0])
        ref, start, name, _, _, ops, flag = struct.unpack_from("<iiBBHHH", body)
        if ref >= 0 and start >= 0 and ops and not flag & UNMAPPED:
            packed = struct.unpack_from(f"<{ops}I", body, 32 + name)
            yield names[ref], start, "".join(f"{x >> 4}{CIGAR[x & 15]}" for x in packed)


def read_bam(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``contig, start, cigar, path`` of the mapped primary alignments of BAM files in a folder that all executors see; each file is streamed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with gzip.open(path.removeprefix("file://"), "rb") as stream:
                    for rows in batched(bam_records(stream), 8192):
                        contig, start, cigar = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(contig), pa.array(start, pa.int64()), pa.array(cigar), pa.array([path] * len(rows))], ["contig", "start", "cigar", "path"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return files.mapInArrow(run, "contig string, start long, cigar string, path string")


def sample_coverage(spark: SparkSession, manifest: DataFrame, contigs: DataFrame) -> DataFrame:
    """``contig, contig_len, sample_name, mean, var`` of the alignment files (``path1``: SAM or BAM) of a manifest, one sample each."""
    out = spark.createDataFrame([], "contig string, contig_len long, sample_name string, mean double, var double")
    for r in manifest.select("sample_name", "path1").distinct().collect():  # one row per file
        found = read_bam(spark, [r["path1"]]) if r["path1"].endswith(".bam") else read_sam(spark, r["path1"])
        # the sample's name is what a coverage table would call it
        name = r["sample_name"].rpartition("/")[2].removesuffix(".sam").replace(".bam", "")
        depths = coverage_of(found.select("contig", "start", "cigar"), contigs)
        out = out.unionByName(depths.where("mean is not null").select("contig", "contig_len", F.lit(name).alias("sample_name"), "mean", "var"))
    return out


def depth_steps(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """``contig, at, depth, length``: stretches of constant depth above 0."""
    whole = alignments.where("contig is not null and start is not null and cigar is not null")
    parts = whole.select("contig", F.explode(cigar_stretches(F.col("start"), F.col("cigar"))).alias("p"))
    inside = parts.join(contigs.select("contig", "contig_len"), "contig").select(
        "contig", F.greatest(F.col("p.start"), F.lit(0)).alias("start"), F.least(F.col("p.end"), F.col("contig_len")).alias("end")
    )
    ends = inside.where("start < end").select("contig", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).cast("long").alias("change")), F.struct(F.col("end").alias("at"), F.lit(-1).cast("long").alias("change")))).alias("e"))
    # all changes of one position at once; the partial sums before the shuffle take the heat out of deep places
    changes = cut(ends.groupBy("contig", "e.at").agg(F.sum("e.change").alias("change")).where("change <> 0"))
    bucket = F.floor(F.col("at") / STRETCH)
    summed = running_sum(changes, ["contig"], bucket, ["at"], F.col("change"), "before").withColumn("depth", F.col("before") + F.col("change"))
    # the next change lies in the same bucket, or is the first of the next bucket that has one
    firsts = changes.groupBy("contig", bucket.alias("bucket")).agg(F.min("at").alias("first"))
    following = firsts.select("contig", "bucket", F.lead("first").over(W.partitionBy("contig").orderBy("bucket")).alias("following"))
    near = summed.withColumn("bucket", bucket).withColumn("next", F.lead("at").over(W.partitionBy("contig", "bucket").orderBy("at")))
    stretched = near.join(following, ["contig", "bucket"]).withColumn("to", F.coalesce("next", "following"))
    return stretched.where("depth > 0").select("contig", "at", "depth", (F.col("to") - F.col("at")).alias("length"))


def coverage_of(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """``contig, contig_len, mean, var`` of every contig (``contig, contig_len``)."""
    steps = depth_steps(alignments, contigs)
    sums = steps.groupBy("contig").agg(F.sum(F.col("depth") * F.col("length")).alias("s"), F.sum(F.col("depth") * F.col("depth") * F.col("length")).alias("q"))
    n, s, q = F.col("contig_len").cast("double"), F.coalesce("s", F.lit(0)).cast("double"), F.coalesce("q", F.lit(0)).cast("double")
    sized = contigs.select("contig", "contig_len").join(sums, "contig", "left")
    mean, var = F.try_divide(s, n), F.try_divide(q - F.try_divide(s * s, n), n - 1)
    return sized.select("contig", "contig_len", F.when(n > 0, mean).alias("mean"), F.when(n == 1, 0.0).when(n > 1, F.greatest(var, F.lit(0.0))).alias("var"))
