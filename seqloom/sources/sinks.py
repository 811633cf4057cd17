"""Sinks: coverage and k-mer tables, bins as FASTA, metrics, and publishing in two steps."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def formatted_coverage(long: DataFrame, samples: Sequence[str]) -> DataFrame:
    """The wide coverage table as text columns of three decimals: contigName, contigLen, totalAvgDepth, then ``<s>``, ``<s>-var``; a missing sample is 0."""
    cell = lambda c: F.format_string("%.3f", F.coalesce(F.col(c), F.lit(0.0)))
    # backticks: sample names may hold dots
    wide = long.groupBy("contig").pivot("sample_name", list(samples)).agg(F.first("mean").alias("mean"), F.first("var").alias("var"))
    stats = long.groupBy("contig").agg(F.max("contig_len").alias("contig_len"), F.avg("mean").alias("avg"))
    columns = [x for s in samples for x in (cell(f"`{s}_mean`").alias(s), cell(f"`{s}_var`").alias(f"{s}-var"))]
    return stats.join(wide, "contig").select(F.col("contig").alias("contigName"), F.col("contig_len").alias("contigLen"), cell("avg").alias("totalAvgDepth"), *columns)


def write_coverage(long: DataFrame, samples: Sequence[str], path: str) -> None:
    formatted_coverage(long, samples).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_kmers(table: DataFrame, path: str, width: int = 136) -> None:
    """Comma separated, no header: contig, then the frequencies."""
    table.select("contig", *(F.get("freqs", F.lit(i)).alias(f"f{i}") for i in range(width))).write.mode("overwrite").option("header", False).csv(path)


def guard(spark: SparkSession, path: str) -> None:
    """An error if the folder already holds bins."""
    fs, where = _fs(spark, path)
    if fs.exists(where) and len(fs.listStatus(where)):
        raise FileExistsError(f"{path} already holds bins")


def write_bins(members: DataFrame, path: str, refuse: bool = True, part_bytes: int = 64 << 20) -> None:
    """``bin, contig_idx, contig, seq`` as FASTA, one folder ``bin=<name>`` each, for ``publish``.

    A bin is one file, or one for every *part_bytes* of sequence, so no bin is one task's alone; each file is in the order of the index.
    """
    if refuse:
        guard(members.sparkSession, path)
    length = F.coalesce(F.length("seq"), F.lit(0)).cast("long")
    parts = members.groupBy("bin").agg(F.ceil(F.sum(length) / F.lit(part_bytes)).alias("parts"))
    part = F.pmod(F.xxhash64("contig_idx"), F.greatest("parts", F.lit(1))).alias("part")
    records = members.join(parts, "bin").select("bin", "contig_idx", part, F.concat(F.lit(">"), "contig", F.lit("\n"), F.coalesce("seq", F.lit(""))).alias("value"))
    ordered = records.repartition("bin", "part").sortWithinPartitions("bin", "contig_idx").select("bin", "value")
    ordered.write.mode("overwrite").partitionBy("bin").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Label, contigs, size and the four distances, tab separated, no header."""
    columns = ["label", "n_contigs", "bin_size", "cov_dist", "tnf_dist", "sketch_dist", "embed_dist"]
    metrics.select(*columns).write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)


def _move(fs, source, target) -> None:  # noqa: ANN001
    """A rename that raises where Hadoop only returns false."""
    if not fs.rename(source, target):
        raise OSError(f"could not move {source} to {target}")


def publish(spark: SparkSession, staged: Sequence[str], target: str, extension: str = ".fna") -> None:
    """Puts the bins of the staged folders into *target* in place of what is there, as ``<bin>.fna``: a file, or a folder of part files for a bin of several.

    The old bins go only when the new ones are complete; a move that fails raises
    before anything is deleted. No bins at all are an error.
    """
    fs, where = _fs(spark, target)
    path = lambda p: _fs(spark, p)[1]
    new, old = f"{target}.new", f"{target}.old"
    for p in (new, old):
        fs.delete(path(p), True)
    fs.mkdirs(path(new))
    found = 0
    for folder in [f for f in staged if fs.exists(path(f))]:
        for status in [s for s in fs.listStatus(path(folder)) if s.isDirectory()]:
            # Hadoop takes no colon in a file's name
            name = unquote(status.getPath().getName().removeprefix("bin=")).replace("/", "%2F").replace(":", "%3A") + extension
            files = [f.getPath() for f in fs.listStatus(status.getPath()) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
            if len(files) > 1:
                fs.mkdirs(path(f"{new}/{name}"))
            for i, f in enumerate(sorted(files, key=str)):
                _move(fs, f, path(f"{new}/{name}/part-{i:05d}{extension}" if len(files) > 1 else f"{new}/{name}"))
            found += bool(files)
    if not found:
        raise ValueError(f"no bins in {list(staged)}")
    had = fs.exists(where)
    if had:
        _move(fs, where, path(old))
    try:
        _move(fs, path(new), where)
    except OSError:
        if had:
            _move(fs, path(old), where)
        raise
    for p in (old, *staged):
        fs.delete(path(p), True)
