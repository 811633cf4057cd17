"""From contigs and coverage to bins, and the refinement of given bins.

The steps are the operators of this package; a table is kept in the shared
folder after the features, the graphs and the embedding. Sets of more than
``hdbscan.MAX_POINTS`` are clustered by ``hdbscan.unbounded``, with one fit in
place of a grid of fits; *cluster*, any function from ``id, vec`` to
``id, label``, replaces both. The layout runs in one task and raises an error
beyond ``embedding.MAX_NODES``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import assignments as A
from seqloom.operators import blocks as B
from seqloom.operators import embedding, graphs, hdbscan, sketched
from seqloom.operators import tables as T
from seqloom.session import cut

Cluster = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Options:
    min_contig_size: int = 1500
    min_bin_size: int = 200_000
    min_contig_count: int = 10
    refining_bin_size: int = 1_000_000
    n_neighbours: int = 100
    filtering_rounds: int = 1
    sketch_k: int = 31
    sketch_scale: float = 0.1
    pseudo_count: float = 1e-6
    prune: bool = True
    strict: bool = False


def coverage_vectors(long: DataFrame, samples: Sequence[str]) -> DataFrame:
    """``contig, cov``: means and variances in turn, 0 for a sample without a row."""
    number = F.create_map(*(x for i, s in enumerate(samples) for x in (F.lit(s), F.lit(i))))
    rows = long.select("contig", F.try_element_at(number, F.col("sample_name")).alias("s"), "mean", "var").where("s is not null")
    wide = rows.groupBy("contig").pivot("s", list(range(len(samples)))).agg(F.first("mean").alias("mean"), F.first("var").alias("var"))
    clean = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))
    return wide.select("contig", F.array(*(clean(f"`{i}_{v}`") for i in range(len(samples)) for v in ("mean", "var"))).alias("cov"))


def features(contigs: DataFrame, coverage: DataFrame, samples: Sequence[str], options: Options = Options(), kmers: DataFrame | None = None) -> DataFrame:
    """``id, contig_len, cov, tnf, hashes`` of the contigs that are long enough and measured. *kmers* (``contig, freqs``) are taken in place of counting."""
    kept, _ = T.by_length(contigs, "contig_len", options.min_contig_size)
    if kmers is None:
        freqs = S.kmer_table(kept, "contig_idx", "seq").select("contig_idx", S.frequencies(F.col("counts")).alias("freqs"))
    else:
        freqs = kept.select("contig_idx", "contig").join(kmers, "contig").select("contig_idx", "freqs")
    tnf = freqs.select("contig_idx", S.log_ratio(F.col("freqs"), options.pseudo_count).alias("tnf"))
    sketch = S.scaled_sketch(kept, "contig_idx", "seq", options.sketch_k, options.sketch_scale).select("contig_idx", "hashes")
    joined = kept.select("contig_idx", "contig", "contig_len").join(coverage_vectors(coverage, samples), "contig").join(tnf, "contig_idx").join(sketch, "contig_idx")
    return cut(joined.select(F.col("contig_idx").alias("id"), "contig_len", "cov", "tnf", "hashes"))


def _graph(rows: DataFrame, vec: str, dims: int, kernel: B.Kernel, k: int) -> DataFrame:
    found = B.search(B.pack(rows, "id", vec, dims, B.QUERY_BLOCK), B.pack(rows, "id", vec, dims), kernel, k, dims)
    return found.select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), "distance", "rank")


def depth_graph(rows: DataFrame, n_samples: int, k: int, strict: bool = False) -> DataFrame:
    """The k nearest of every contig by coverage distance times sketch distance, of all contigs."""
    vectors = rows.select("id", F.col("cov").alias("vec"), "hashes")
    found = sketched.search(vectors, B.coverage_strict if strict else B.coverage, k, 2 * n_samples)
    return found.select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), "distance", "rank")


def neighbour_graph(rows: DataFrame, n_samples: int, k: int, keep_n: int, options: Options) -> DataFrame:
    """The depth graph (coverage times sketch distance) cut by the k-mer graph."""
    depth = depth_graph(rows, n_samples, k, options.strict)
    return graphs.combined(cut(depth), cut(_graph(rows, "tnf", 136, B.proportional, k)), keep_n, options.prune)


def cluster_each(points: DataFrame, key: str) -> DataFrame:
    """``key, id, label`` of each group of *points* (``key, id, vec``) on its own: the grid's best fit in one task, or beyond its bound one distributed fit."""
    points = cut(points.select(key, "id", "vec").where("id is not null and vec is not null"))
    counts = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # groups of more than the bound are few
    large = [r[0] for r in counts.where(F.col("n") > hdbscan.MAX_POINTS).select(key).collect()]
    small = points.where(~F.col(key).isin(large)) if large else points
    out = hdbscan.cluster_groups(small, [key], "id", "vec", choose=hdbscan.best_labels)
    for name in large:
        found = hdbscan.unbounded(points.where(F.col(key) == name).select("id", "vec"))
        out = out.unionByName(found.select(F.lit(name).alias(key), "id", "label"))
    return out


def _cluster_once(rows: DataFrame, n_samples: int, options: Options, cluster: Cluster | None, layouts: list[DataFrame]) -> DataFrame:
    """``id, label`` of one pass: graph, pre-filter, embedding, clusters; removed contigs are outliers."""
    n = rows.count()
    if n < 3:
        return rows.select("id", F.lit(None).cast("int").alias("label"))
    k = max(1, A.adaptive_k(n, options.n_neighbours))
    dims = A.embedding_dims(2 * n_samples)

    def build(nodes: DataFrame, keep_n: int) -> DataFrame:
        return neighbour_graph(rows.join(nodes.select(F.col("src").alias("id")), "id", "left_semi"), n_samples, k, keep_n, options)

    nodes, edges, gone = graphs.prefilter(rows.select(F.col("id").alias("src")), build, 0, k, options.filtering_rounds)

    def denser(more: int) -> DataFrame:
        return edges if more == k else build(nodes, more - k)

    placed = embedding.embed_with_retry(denser, k, dims)
    layouts.append(placed)
    found = cluster(placed) if cluster else cluster_each(placed.withColumn("one", F.lit("")), "one").select("id", "label")
    return found.unionByName(gone.select(F.col("src").alias("id"), F.lit(None).cast("int").alias("label")))


def cluster_contigs(rows: DataFrame, n_samples: int, options: Options = Options(), cluster: Cluster | None = None, layouts: list[DataFrame] | None = None) -> DataFrame:
    """``contig_idx, label`` of all *rows*; outliers are clustered once more among themselves and added behind. The layouts of both rounds are added to *layouts*."""
    layouts = [] if layouts is None else layouts
    first = cut(_cluster_once(rows, n_samples, options, cluster, layouts))
    outliers = cut(rows.join(first.where("label is null").select("id"), "id", "left_semi"))
    if outliers.count() < 3:
        return first.withColumnRenamed("id", "contig_idx")
    again = cut(_cluster_once(outliers, n_samples, options, cluster, layouts))
    renamed = lambda t: t.withColumnRenamed("id", "contig_idx").select("label", "contig_idx")
    return A.merge_clusterings(renamed(first), renamed(again)).select("contig_idx", "label")


def bin_metrics(members: DataFrame, rows: DataFrame, n_samples: int, points: DataFrame | None = None) -> DataFrame:
    """``label, n_contigs, bin_size, cov_dist, tnf_dist, sketch_dist, embed_dist`` of the clusters of *members* (``label, contig_idx``).

    The mean distances over the pairs of a cluster by coverage, k-mer profile, sketch
    and place (*points*: ``id, vec``; null without), NaN for a single contig. *rows*
    are the features.
    """
    own = members.where("label is not null").select("label", F.col("contig_idx").alias("id"))
    held = cut(rows.join(own, "id").repartition("label", F.pmod(F.xxhash64("id"), F.lit(8))))
    out = held.groupBy("label").agg(F.count(F.lit(1)).alias("n_contigs"), F.sum("contig_len").alias("bin_size"))

    def mean(table: DataFrame, vec: str, kernel: B.Kernel, dims: int, name: str) -> DataFrame:
        blocks = cut(B.pack(table, "id", vec, dims, label="label", by_label=True))
        return B.within_means(blocks, kernel, dims).select("label", F.col("mean_distance").alias(name))

    parts = [mean(held, "cov", B.coverage, 2 * n_samples, "cov_dist"), mean(held, "tnf", B.proportional, 136, "tnf_dist")]
    parts.append(sketched.within_means(held).select("label", F.col("mean_distance").alias("sketch_dist")))
    if points is not None:
        dims = A.embedding_dims(2 * n_samples)
        parts.append(mean(points.join(own, "id").repartition("label", F.pmod(F.xxhash64("id"), F.lit(8))), "vec", B.euclid, dims, "embed_dist"))
    for p in parts:
        out = out.join(p, "label", "left")
    return out if points is not None else out.withColumn("embed_dist", F.lit(None).cast("double"))


def recover(contigs: DataFrame, coverage: DataFrame, samples: Sequence[str], options: Options = Options(), cluster: Cluster | None = None, to_refine: bool = False, metrics_to: Callable[[DataFrame], None] | None = None, kmers: DataFrame | None = None) -> DataFrame:
    """``bin, contig_idx, contig, seq`` of every contig (``contig_idx, contig, seq, contig_len``).

    *metrics_to* is given the clusters' metrics; an embedding distance is that of the
    first layout, or of the second for contigs that were clustered there.
    """
    rows = features(contigs, coverage, samples, options, kmers)
    layouts: list[DataFrame] = []
    labels = cut(cluster_contigs(rows, len(samples), options, cluster, layouts))
    if metrics_to:
        points = layouts[-1].join(rows.select("id"), "id", "left_semi") if layouts else None
        for earlier in layouts[-2::-1]:
            points = points.unionByName(earlier.join(points.select("id"), "id", "left_anti"))
        metrics_to(bin_metrics(labels, rows, len(samples), points))
    sized = labels.join(contigs.select("contig_idx", "contig_len"), "contig_idx")
    kept = A.gate_by_size(sized, ("label",), options.min_bin_size).select("contig_idx", F.col("kept_label").alias("label"))
    named = A.bin_names(contigs.select("contig_idx", "contig_len").join(kept, "contig_idx", "left"), options.min_contig_size, options.refining_bin_size if to_refine else options.min_bin_size)
    return named.join(contigs.select("contig_idx", "contig", "seq"), "contig_idx").select("bin", "contig_idx", "contig", "seq")


def refine(bins: DataFrame, vectors: DataFrame, options: Options = Options(), tag: str = "refined_1", split: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``contig_idx, bin, refined`` of ``bin, contig_idx, contig_len``: each bin that is large enough is clustered on its own.

    *vectors*: ``id, vec``. Unbinned bins and those without enough long contigs stay
    as they are, and so does a bin that comes back whole. Small parts go to the bin's
    rest. *split* replaces the clustering (``bin, id, vec`` to ``bin, id, label``).
    """
    apart = A.name_contains(F.col("bin"), "unbinned")
    sized = A.requirements(bins.withColumn("label", F.lit(1)), ("bin",), options.min_contig_size, options.min_contig_count, options.min_bin_size, "contig_len")
    work = cut(bins.where(~apart).join(sized.where("passes").select("bin"), "bin", "left_semi"))
    points = work.select("bin", F.col("contig_idx").alias("id")).join(vectors, "id")
    parts = split(points) if split else cluster_each(points, "bin")
    # a contig that no cluster took is in the bin's rest, label 0; clusters count from 1
    back = cut(work.join(parts.withColumnRenamed("id", "contig_idx"), ["bin", "contig_idx"], "left").withColumn("label", F.coalesce(F.col("label") + 1, F.lit(0))))
    decided = A.refine_decision(back, work.groupBy("bin").agg(F.count(F.lit(1)).alias("n_contigs")), options.min_bin_size)
    changed = back.join(decided.where("changed").select("bin"), "bin", "left_semi")
    folded = A.fold_small(changed, ("bin", "label"), options.min_bin_size).select("bin", "contig_idx", "contig_len", F.col("folded_label").alias("label"))
    numbers = A.offset_labels(folded.where("label <> 0"), "bin", "label")
    numbered = folded.join(numbers, ["bin", "label"], "left").select("contig_idx", "contig_len", F.col("global_label").alias("label"))
    new = A.bin_names(numbered, 0, options.min_bin_size, tag, tag).withColumn("refined", F.lit(True))
    untouched = bins.join(new.select("contig_idx"), "contig_idx", "left_anti").select("contig_idx", "bin", F.lit(False).alias("refined"))
    return new.unionByName(untouched)
