"""Coverage and feature tables: filters, merges, lookups.

All keep every row unless a condition says otherwise; a null key matches
nothing; repeated keys of a lookup table count once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.ranks import running_sum
from seqloom.session import cut


def first_token(name: Column) -> Column:
    return F.regexp_extract(name, r"(\S+)", 1)


def sample_name(header: Column) -> Column:
    """The sample that a header cell or path names: after the last slash, without ``.bam``, first token."""
    return first_token(F.replace(F.substring_index(header, "/", -1), F.lit(".bam"), F.lit("")))


def by_length(df: DataFrame, length: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows of at least that length, and the others (a null length is among these)."""
    long_enough = F.coalesce(F.col(length) >= least, F.lit(False))
    return df.where(long_enough), df.where(~long_enough)


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose *key* is not in *other*."""
    return df.join(other.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def only(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose *key* is in *other*."""
    return df.join(other.select(key).distinct(), key, "left_semi")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by *order* (nulls first). Partly aggregated before the shuffle, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def long_coverage(coverage: DataFrame) -> DataFrame:
    """``contig, contig_len, sample_name, mean, var``: the delivered rows with a name and a mean, the last received of each contig and sample. A NaN variance is null."""
    named = coverage.select(
        first_token(F.col("contig")).alias("contig"), "contig_len", "sample_name", F.col("mean_depth").alias("mean"), F.when(~F.isnan("var_depth"), F.col("var_depth")).alias("var"), "received_at", "cov_id"
    )
    kept = named.where("contig <> '' and sample_name is not null and mean is not null and not isnan(mean)")
    return latest(kept, ["contig", "sample_name"], ["received_at", "cov_id"]).select("contig", "contig_len", "sample_name", "mean", "var")


def wide_coverage(long: DataFrame, samples: Sequence[str]) -> DataFrame:
    """``contig, <sample>_mean, <sample>_var``: one row per contig, null where a sample has no row."""
    return long.groupBy("contig").pivot("sample_name", list(samples)).agg(F.first("mean").alias("mean"), F.first("var").alias("var"))


def average_depth(long: DataFrame) -> DataFrame:
    """The mean of each contig's sample means."""
    return long.groupBy("contig").agg(F.avg("mean").alias("avg_depth"), F.count(F.lit(1)).alias("n_samples"))


def merge(tables: Sequence[DataFrame]) -> DataFrame:
    """Coverage of several tables in one; a sample that two tables have is taken from the first of them."""
    ranked = [t.withColumn("__table", F.lit(-i)) for i, t in enumerate(tables)]
    return latest(reduce(DataFrame.unionByName, ranked), ["contig", "sample_name"], ["__table"]).drop("__table")


def contig_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Contigs that only one of two tables has; merging by position would need none."""
    x, y = a.select("contig").distinct(), b.select("contig").distinct()
    return x.join(y, "contig", "left_anti").union(y.join(x, "contig", "left_anti"))


def missing_samples(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Samples of the manifest that no coverage row has yet; both names are normalised."""
    have = done.select(sample_name(F.col("sample_name")).alias("__s")).distinct()
    return manifest.join(have, sample_name(F.col("sample_name")) == F.col("__s"), "left_anti")


def of_kinds(manifest: DataFrame, kinds: Sequence[str], names: DataFrame | None = None) -> DataFrame:
    """The manifest's samples of these kinds, and of these normalised ``sample_name`` if given."""
    rows = manifest.where(F.col("kind").isin(list(kinds)))
    if names is None:
        return rows
    wanted = names.select(sample_name(F.col("sample_name")).alias("__s")).where("__s is not null").distinct()
    return rows.join(wanted, sample_name(F.col("sample_name")) == F.col("__s"), "left_semi")


def complete(manifest: DataFrame, done: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """*done* (``contig, contig_len, sample_name, mean, var``) with the coverage that *compute* gives of the manifest's samples it lacks."""
    return merge([done, compute(missing_samples(manifest, done)).select(*done.columns)])


def feature_join(stats: DataFrame, tnf: DataFrame, sketch: DataFrame) -> DataFrame:
    """Coverage, k-mer and sketch features of the contigs that have all three, by contig."""
    return stats.join(tnf, "contig").join(sketch, "contig")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, parts: int = 0) -> DataFrame:
    """0, 1, 2, ... per key in the order of *order*, whatever the size of a key: ranges of rows are counted, and each row adds its place in its range."""
    parts = parts or max(1, df.sparkSession.sparkContext.defaultParallelism)
    spread = cut(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    # ranges are in order and rows within one are ordered by the running sum
    return running_sum(spread, list(keys), F.col("__range"), list(order), F.lit(1).cast("long"), out).drop("__range")


def row_index(df: DataFrame, order: Sequence[str], out: str = "row_index", parts: int = 0) -> DataFrame:
    """0, 1, 2, ... in the order of *order*."""
    return numbered(df, [], order, out, parts)


def rank_in(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1, 2, 3, ... per key; for keys of bounded groups."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
