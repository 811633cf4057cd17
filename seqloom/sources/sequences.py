"""FASTA and FASTQ files as DataFrames; lines end in LF or CRLF, gzip is read too.

The kind of each file is told by its first byte (``>`` or ``@``), not by its
extension. An empty file gives no rows. ``contig_idx`` is the place of a record in the order
of files and offsets, given once and carried on.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.sequences import normalised
from seqloom.operators.ranks import running_sum
from seqloom.operators.tables import row_index
from seqloom.session import cut

_PLACE = ["file", "block", "at"]


def _text(spark: SparkSession, path: str | list[str], separator: str | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.read
    if separator:
        reader = reader.option("lineSep", separator)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )


def files_of(spark: SparkSession, path: str | list[str], glob: str | None = None) -> list[str]:
    """The files of a path, folders with all that lies below them."""
    reader = spark.read.option("recursiveFileLookup", True)
    found = (reader.option("pathGlobFilter", glob) if glob else reader).text(path).inputFiles()
    return sorted(unquote(file) for file in found)


def is_fastq(spark: SparkSession, file: str) -> bool:
    """Whether a file's first byte other than white space says FASTQ; only its beginning is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(file)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
    stream = where.getFileSystem(conf).open(where)
    stream = codec.createInputStream(stream) if codec else stream
    try:
        while (byte := stream.read()) in (9, 10, 13, 32):
            pass
        return byte == ord("@")
    finally:
        stream.close()


def read_fasta(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``file, block, at, contig, description, seq``: one row per record; a record may be as long as a string can be."""
    records = _text(spark, path, "\n>", glob)
    body = F.regexp_replace("value", "^\\s*>", "")
    head = F.regexp_extract(body, r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(body, r"^[^\r\n]*", "")
    rows = records.where("trim(value) <> ''").select(*_PLACE, head.alias("head"), normalised(seq).alias("seq"))
    return rows.select(*_PLACE, F.regexp_extract("head", r"^(\S*)", 1).alias("contig"), F.trim(F.regexp_replace("head", r"^\S*", "")).alias("description"), "seq")


def read_fastq(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``file, block, at, contig, description, seq``: records of four lines, found by their line number in the file."""
    lines = cut(_text(spark, path, None, glob).withColumn("value", F.regexp_replace("value", "\r$", "")))
    numbered = running_sum(lines, ["file"], F.col("block"), ["at"], F.lit(1).cast("long"), "line")
    record = numbered.withColumn("record", F.floor(F.col("line") / 4)).where("line % 4 < 2")
    rows = record.groupBy("file", "record").agg(
        F.min("block").alias("block"), F.min("at").alias("at"), F.max(F.when(F.col("line") % 4 == 0, F.col("value"))).alias("head"), F.max(F.when(F.col("line") % 4 == 1, F.col("value"))).alias("seq")
    )
    head = F.substring("head", 2, 1 << 30)
    return rows.where("head <> ''").select(*_PLACE, F.regexp_extract(head, r"^(\S*)", 1).alias("contig"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), normalised(F.col("seq")).alias("seq"))


def read_records(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``file, block, at, contig, description, seq`` of the records of all files, each read by its own kind."""
    files: dict[bool, list[str]] = {False: [], True: []}
    for file in files_of(spark, path, glob):
        files[is_fastq(spark, file)].append(file)
    # a path without files still gives a table, of no rows
    parts = [read(spark, names) for read, names in ((read_fasta, files[False]), (read_fastq, files[True])) if names]
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else spark.createDataFrame([], "file string, block long, at long, contig string, description string, seq string")


def read_contigs(spark: SparkSession, path: str | list[str], least_length: int = 0, glob: str | None = None) -> DataFrame:
    """``contig_idx, contig, seq, contig_len, file`` of an assembly in FASTA or FASTQ."""
    indexed = row_index(read_records(spark, path, glob), _PLACE, "contig_idx")
    sized = indexed.select("contig_idx", "contig", "seq", F.length("seq").cast("long").alias("contig_len"), "file")
    return sized.where(F.col("contig_len") >= least_length)


def read_bins(spark: SparkSession, path: str | list[str], extension: str = ".fna") -> DataFrame:
    """``bin, contig, seq, contig_len`` of a folder, or of a list of files; an error if there is no bin.

    A bin is a file of that extension, or a folder of that extension whose files are
    its parts.
    """
    rows = read_records(spark, path, f"*{extension}" if isinstance(path, str) else None)
    names = F.split("file", "/")
    last, folder = F.element_at(names, -1), F.element_at(names, -2)
    written = F.when(F.endswith(folder, F.lit(extension)), folder).otherwise(last)
    # paths come with percent signs, and ``publish`` has its own for slashes and colons
    name = F.url_decode(F.replace(written, F.lit("+"), F.lit("%2B")))
    name = F.replace(F.replace(name, F.lit("%2F"), F.lit("/")), F.lit("%3A"), F.lit(":"))
    cut_off = F.when(F.endswith(name, F.lit(extension)), F.substring(name, F.lit(1), F.length(name) - len(extension))).otherwise(name)
    bins = rows.select(cut_off.alias("bin"), "contig", "seq", F.length("seq").cast("long").alias("contig_len"))
    if bins.isEmpty():
        raise ValueError(f"no bins ({extension}) in {path}")
    return bins
