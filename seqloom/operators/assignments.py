"""Clusterings as tables ``label, contig_idx`` (label null for outliers): checks, merges, gates and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.tables import numbered


def latest_assignments(membership: DataFrame) -> DataFrame:
    """One row per run and contig: the last assigned, the smaller label (outliers first) on ties."""
    best = membership.groupBy("run_id", "contig_idx").agg(F.max_by(F.struct("label", "contig_len"), F.struct("assigned_at", -F.coalesce("label", F.lit(-1)))).alias("r"))
    return best.select("run_id", "contig_idx", "r.label", "r.contig_len")


def bin_sizes(members: DataFrame, keys: tuple[str, ...] = ("run_id", "label"), length: str = "contig_len") -> DataFrame:
    """Contigs and total length of each bin; outliers are no bin."""
    return members.where("label is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_contigs"), F.coalesce(F.sum(length), F.lit(0)).alias("bin_size"))


def requirements(members: DataFrame, keys: tuple[str, ...], least_length: int, least_count: int, least_size: int, length: str = "contig_len") -> DataFrame:
    """Per bin: contigs and size counted over contigs of at least *least_length*, and whether both reach what is asked."""
    long_enough = F.col(length) >= least_length
    counted = members.where("label is not null").groupBy(*keys).agg(
        F.count_if(long_enough).alias("n_long"), F.coalesce(F.sum(F.when(long_enough, F.col(length))), F.lit(0)).alias("long_size")
    )
    return counted.withColumn("passes", (F.col("n_long") >= least_count) & (F.col("long_size") >= least_size))


def gate_by_size(members: DataFrame, keys: tuple[str, ...], least_size: int, length: str = "contig_len") -> DataFrame:
    """Members with ``kept_label``: null where the bin is smaller than *least_size* or has label 0."""
    sizes = bin_sizes(members, keys, length).select(*keys, "bin_size")
    joined = members.join(sizes, list(keys), "left")
    return joined.withColumn("kept_label", F.when((F.col("bin_size") >= least_size) & (F.col("label") != 0), F.col("label"))).drop("bin_size")


def fold_small(members: DataFrame, keys: tuple[str, ...], least_size: int, length: str = "contig_len") -> DataFrame:
    """Members with bins smaller than *least_size* moved to label 0."""
    sizes = bin_sizes(members, keys, length).select(*keys, "bin_size")
    joined = members.join(sizes, list(keys), "left")
    return joined.withColumn("folded_label", F.when(F.col("bin_size") < least_size, 0).otherwise(F.col("label"))).drop("bin_size")


def dense_labels(members: DataFrame, run: str = "run_id") -> DataFrame:
    """Labels renumbered 0, 1, ... per run by their smallest contig, so that the numbers depend on no order of rows."""
    least = members.where("label is not null").groupBy(run, "label").agg(F.min("contig_idx").alias("__least"))
    ranked = numbered(least, [run], ["__least", "label"], "__n").select(run, "label", F.col("__n").cast("int").alias("dense_label"))
    return members.join(ranked, [run, "label"], "left")


def offset_labels(bins: DataFrame, bin_: str, label: str) -> DataFrame:
    """A global number 1, 2, ... for every (bin, label) in that order."""
    distinct = bins.where(F.col(label).isNotNull()).select(bin_, label).distinct()
    return numbered(distinct, [], [bin_, label], "__n").select(bin_, label, (F.col("__n") + 1).cast("int").alias("global_label"))


def merge_clusterings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both clusterings' members; b's labels are renumbered from a's largest plus one in their order, and b's outliers replace a's."""
    top = a.agg(F.coalesce(F.max("label"), F.lit(0)).alias("top"))
    labels = b.where("label is not null").select("label").distinct()
    # one row of a's largest label
    moved = numbered(labels, [], ["label"], "__n").crossJoin(F.broadcast(top)).select("label", (F.col("__n") + 1 + F.col("top")).cast("int").alias("new_label"))
    theirs = b.join(moved, "label", "left").select(F.col("new_label").alias("label"), "contig_idx")
    return a.where("label is not null").select("label", "contig_idx").unionByName(theirs)


def append_clusters(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's members and outliers with b's clusters behind them; b's outliers are left out. An empty a is fine."""
    merged = merge_clusterings(a, b.where("label is not null"))
    return merged.unionByName(a.where("label is null").select("label", "contig_idx"))


def merge_by_super_clusters(members: DataFrame, supers: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Clusters united by their super-cluster (``label, super_label``, null: kept alone), renumbered 0, 1, ... (per *keys*): united ones first, each by its smallest label."""
    joined = members.where("label is not null").join(supers, [*keys, "label"], "left")
    key = F.when(F.col("super_label").isNull(), F.struct(F.lit(1).alias("alone"), F.col("label").cast("long").alias("k"))).otherwise(F.struct(F.lit(0).alias("alone"), F.col("super_label").cast("long").alias("k")))
    grouped = joined.withColumn("__key", key)
    order = grouped.groupBy(*keys, "__key").agg(F.min("label").alias("__least")).withColumn("__alone", F.col("__key.alone"))
    ranked = numbered(order, keys, ["__alone", "__least"], "__n").select(*keys, "__key", F.col("__n").cast("int").alias("merged_label"))
    return grouped.join(ranked, [*keys, "__key"]).select(*keys, "merged_label", "contig_idx")


def split_by_size(members: DataFrame, most: int, least: int, remove_large: bool = True, length: str = "contig_len", keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """Members with ``part``: ``large`` (bins of at least *most*, set aside), ``cluster``, ``single`` (outliers of at least *least*, each a new cluster) or ``outlier``."""
    sizes = bin_sizes(members, keys, length).select(*keys, "bin_size")
    joined = members.join(sizes, list(keys), "left")
    large = F.lit(remove_large) & (F.col("bin_size") >= most)
    part = F.when(F.col("label").isNull(), F.when(F.col(length) >= least, "single").otherwise("outlier")).when(large, "large").otherwise("cluster")
    return joined.withColumn("part", part).drop("bin_size")


def refine_decision(results: DataFrame, originals: DataFrame, least_size: int, length: str = "contig_len", keys: tuple[str, ...] = ("bin",)) -> DataFrame:
    """Per refined bin (*keys*) ``bin, changed``, from ``bin, label, contig_idx, contig_len`` and the original ``bin, n_contigs``.

    A bin is unchanged if nothing came back, or one cluster that holds all of its contigs.
    """
    got = results.groupBy(*keys).agg(F.countDistinct("label").alias("n_labels"), F.count(F.lit(1)).alias("n_back"))
    joined = originals.join(got, list(keys), "left")
    same = F.coalesce("n_labels", F.lit(0)) == 0
    whole = (F.col("n_labels") == 1) & (F.col("n_back") == F.col("n_contigs"))
    return joined.select(*keys, (~(same | F.coalesce(whole, F.lit(False)))).alias("changed"))


def bin_names(contigs: DataFrame, least_contig: int, least_bin: int, prefix: str = "bin", tag: str = "", keys: tuple[str, ...] = ()) -> DataFrame:
    """``contig_idx, bin`` of every contig (``contig_idx, contig_len, label, clustered``).

    A contig below *least_contig* is ``small_unbinned``, or alone if it is as long as
    a bin; a clustered one goes to its label; an outlier is ``unbinned``, or alone if
    long enough. Contigs that no clustering saw are ``unbinned`` too. Lone contigs are
    numbered in the order of their index, per *keys*.
    """
    small = F.coalesce(F.col("contig_len"), F.lit(0)) < least_contig
    big = F.coalesce(F.col("contig_len"), F.lit(0)) >= least_bin
    kind = F.when(small & ~big, "small_unbinned").when(~small & F.col("label").isNotNull(), "label").when(big, "single").otherwise("unbinned")
    rows = contigs.withColumn("__kind", kind)
    single = numbered(rows.where("__kind = 'single'").select(*keys, "contig_idx"), keys, ["contig_idx"], "__n").withColumn("__n", F.col("__n") + 1)
    named = rows.join(single, [*keys, "contig_idx"], "left")
    lone = F.concat(F.lit(f"single_contig_{tag}_" if tag else "single_contig_"), F.col("__n").cast("string"))
    name = F.when(F.col("__kind") == "label", F.col("label").cast("string")).when(F.col("__kind") == "single", lone).otherwise(F.col("__kind"))
    return named.select(*keys, "contig_idx", F.concat(F.lit(f"{prefix}_"), name).alias("bin"))


def outlier_share(members: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    return members.groupBy(*keys).agg(F.avg(F.col("label").isNull().cast("double")).alias("outlier_share"))


def conservation(members: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Per run: clustered and outlying contigs and whether they make up all that were expected (``n_expected``)."""
    counted = members.groupBy(*keys).agg(F.count_if(F.col("label").isNotNull()).alias("n_clustered"), F.count_if(F.col("label").isNull()).alias("n_outliers"))
    return counted.join(expected, list(keys), "left").withColumn("conserved", F.col("n_clustered") + F.col("n_outliers") == F.col("n_expected"))


def bin_names_of(members: DataFrame, names: DataFrame, keys: tuple[str, ...] = ("run_id", "label")) -> DataFrame:
    """The distinct names of each bin's contigs, a row each; *names*: ``contig_idx, contig``."""
    return members.where("label is not null").join(names.where("contig is not null"), "contig_idx").select(*keys, "contig").distinct()


def contig_to_cluster(clusters: DataFrame) -> DataFrame:
    """``label, members array`` exploded to ``contig_idx, label``."""
    return clusters.select(F.explode("members").alias("contig_idx"), "label")


def name_contains(path: Column, part: str) -> Column:
    """Whether the whole path holds *part*."""
    return F.coalesce(F.contains(path, F.lit(part)), F.lit(False))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def adaptive_k(n: int, k: int) -> int:
    """Fewer neighbours for small graphs."""
    return min(n // 2, k) if n < 10 * k else k


def embedding_dims(n_columns: int) -> int:
    return min(max(n_columns // 2, 2), 10)


def best_of_grid(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The grid row of the best score, NaN as 0; the first by ``min_cluster_size, min_samples`` on ties."""
    clean = scores.withColumn("score", F.when(F.isnan("score") | F.col("score").isNull(), 0.0).otherwise(F.col("score")))
    order = F.struct(F.col("score"), -F.col("min_cluster_size"), -F.col("min_samples"))
    best = clean.groupBy(*keys).agg(F.max(order).alias("o"))
    return best.select(*keys, (-F.col("o.col2")).alias("min_cluster_size"), (-F.col("o.col3")).alias("min_samples"), F.col("o.score").alias("score"))
