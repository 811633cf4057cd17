"""Coverage tables, k-mer tables, cluster maps and read manifests."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.rejects import sample_name

LONG_COVERAGE = "contig string, contig_len long, sample_name string, mean double, var double"
KINDS = ("paired", "coupled", "interleaved", "single", "long", "short_bam", "long_bam")


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def samples_of(header: Sequence[str], first: int, step: int) -> list[str]:
    """Sample names of a header: every *step*-th cell from *first*, its first word without folders and ``.bam``."""
    return [sample_name(h).split()[0] for h in header[first::step]]


def _long(raw: DataFrame, columns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Triples (sample, mean column, variance column) as rows."""
    cell = lambda c: F.trim(F.col(f"`{c}`")).cast("double")
    parts = F.array(*(F.struct(F.lit(s).alias("sample_name"), cell(m).alias("mean"), cell(v).alias("var")) for s, m, v in columns))
    name, length = (F.trim(F.col(f"`{c}`")) for c in raw.columns[:2])
    return raw.select(name.alias("contig"), length.cast("long").alias("contig_len"), F.explode(parts).alias("x")).select("contig", "contig_len", "x.*")


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """A coverage table (name, length, average depth, then mean and variance per sample) in long form."""
    raw = _raw(spark, path)
    cols = raw.columns
    return _long(raw, list(zip(samples_of(cols, 3, 2), cols[3::2], cols[4::2], strict=True)))


def read_long_read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """A table of name, then length, mean and variance per sample, in long form; the repeated lengths are skipped."""
    raw = _raw(spark, path)
    cols = raw.columns
    return _long(raw, list(zip(samples_of(cols, 2, 3), cols[2::3], cols[3::3], strict=True)))


def read_kmers(spark: SparkSession, path: str) -> DataFrame:
    """``contig, freqs`` of a comma separated table without header."""
    raw = spark.read.csv(path)
    return raw.select(F.col(raw.columns[0]).alias("contig"), F.array(*(F.col(c).cast("double") for c in raw.columns[1:])).alias("freqs"))


def explode_clusters(maps: DataFrame, column: str) -> DataFrame:
    """``label, contig_idx`` of JSON objects of arrays by label; broken JSON gives no rows."""
    parsed = maps.select(F.explode(F.from_json(column, "map<string,array<bigint>>")).alias("label", "members"))
    return parsed.select(F.expr("try_cast(label as int)").alias("label"), F.explode("members").alias("contig_idx"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return explode_clusters(spark.read.option("wholetext", True).text(path), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, gzip or not."""
    return spark.read.text(path)


def manifest(spark: SparkSession, read1: Sequence[str] = (), read2: Sequence[str] = (), **paths: Sequence[str]) -> DataFrame:
    """``sample_name, kind, path1, path2`` of read and BAM files; *paths* by the other kinds of KINDS.

    Paired files come in two lists of equal length, coupled ones in one list of pairs.
    """
    if len(read1) != len(read2):
        raise ValueError(f"{len(read1)} first and {len(read2)} second read files")
    if unknown := set(paths) - set(KINDS[1:]):
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    if len(coupled := list(paths.pop("coupled", ()))) % 2:
        raise ValueError("coupled files need an even number of paths")
    rows = [("paired", a, b) for a, b in zip(read1, read2, strict=True)] + [("coupled", a, b) for a, b in batched(coupled, 2, strict=True)]
    rows += [(kind, p, None) for kind in KINDS for p in paths.get(kind, ())]
    if not rows:
        raise ValueError("no reads and no BAM files")
    return spark.createDataFrame([(p.rpartition("/")[2], k, p, q) for k, p, q in rows], "sample_name string, kind string, path1 string, path2 string")
