"""python -m seqloom recover|refine: bins from an assembly and its coverage, or better bins from bins."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.functions.arrays import let, total
from seqloom.operators import depth
from seqloom.operators import tables as T
from seqloom.plans import recover as R
from seqloom.session import build_session, cut
from seqloom.sources import sequences, sinks, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    defaults = R.Options()
    for name in ("recover", "refine"):
        s = sub.add_parser(name)
        s.add_argument("-C", "--coverage-file", help="coverage table: name, length, average, then mean and variance per sample")
        s.add_argument("--long-read-coverage-file", help="coverage table: name, then length, mean and variance per sample")
        s.add_argument("--sam-files", nargs="+", default=[], help="alignments as SAM text, one sample each; samples of the coverage table are not computed again")
        s.add_argument("--bam-files", nargs="+", default=[], help="short-read alignments, one sample each")
        s.add_argument("--longread-bam-files", nargs="+", default=[])
        s.add_argument("-K", "--kmer-frequency-file", help="k-mer table: name, then the frequencies; counted from the sequences if not given")
        s.add_argument("-o", "--output-directory", required=True)
        s.add_argument("--min-contig-size", type=int, default=defaults.min_contig_size)
        s.add_argument("--min-bin-size", type=int, default=defaults.min_bin_size)
        s.add_argument("--min-contig-count", type=int, default=defaults.min_contig_count)
        s.add_argument("--n-neighbours", type=int, default=defaults.n_neighbours)
        s.add_argument("--filtering-rounds", type=int, default=defaults.filtering_rounds)
        s.add_argument("--master", help="Spark master, if none is configured")
    one = sub.choices["recover"]
    one.add_argument("-r", "--assembly", required=True, help="contigs in FASTA or FASTQ")
    one.add_argument("--kmer-size", type=int, default=defaults.sketch_k, help="k-mers of the sketches")
    one.add_argument("--sketch-scale", type=float, default=defaults.sketch_scale)
    one.add_argument("--skip-refine", action="store_true")
    one.add_argument("--metrics", help="folder for the clusters' metrics")
    one.add_argument("--write-coverage", help="folder for the coverage table that was computed")
    two = sub.choices["refine"]
    bins = two.add_mutually_exclusive_group(required=True)
    bins.add_argument("-d", "--genome-directory", help="a folder of bins, as recover writes it")
    bins.add_argument("-f", "--genome-files", nargs="+", help="bins, one file each")
    two.add_argument("-x", "--extension", default=".fna")
    two.add_argument("--bin-tag", default="refined_1")
    return p


def options(args: argparse.Namespace) -> R.Options:
    shared = {k: getattr(args, k) for k in ("min_contig_size", "min_bin_size", "min_contig_count", "n_neighbours", "filtering_rounds")}
    more = {"sketch_k": args.kmer_size, "sketch_scale": args.sketch_scale} if args.command == "recover" else {}
    return R.Options(**shared, **more)


def coverage(spark: SparkSession, args: argparse.Namespace, contigs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``contig, contig_len, sample_name, mean, var`` and the samples: tables that are given, and what they lack from alignments."""
    given = [read(spark, path) for read, path in ((tables.read_coverage, args.coverage_file), (tables.read_long_read_coverage, args.long_read_coverage_file)) if path]
    kinds = {"sam": args.sam_files, "short_bam": args.bam_files, "long_bam": args.longread_bam_files}
    if not given and not any(kinds.values()):
        raise SystemExit("give a coverage table or alignments")
    done = T.merge(given) if given else spark.createDataFrame([], tables.LONG_COVERAGE)
    if any(kinds.values()):
        files = spark.createDataFrame([(p.rpartition("/")[2].removesuffix(".sam"), k, p) for k, ps in kinds.items() for p in ps], "sample_name string, kind string, path1 string")
        sized = contigs.select("contig", "contig_len")
        done = T.complete(files, done, lambda lacking: depth.sample_coverage(spark, lacking, sized))
    rows = cut(done)
    return rows, sorted(r[0] for r in rows.select("sample_name").distinct().collect())  # the samples of a header


def bin_vectors(contigs: DataFrame, coverage: DataFrame, samples: Sequence[str], options: R.Options = R.Options(), kmers: DataFrame | None = None) -> DataFrame:
    """``id, vec``: logarithms of the mean depths, then the k-mer profile's log ratios, centred and of length 1 (zeros for a contig without k-mers).

    Between profiles the square of the distance is 2 - 2 times their correlation.
    *kmers* (``contig, freqs``) are taken by contig in place of counting.
    """
    cov = R.coverage_vectors(coverage, samples).join(contigs.select("contig", "contig_idx"), "contig")
    means = F.transform(F.filter("cov", lambda x, i: i % 2 == 0), lambda x: F.log1p(x))
    if kmers is None:
        freqs = S.kmer_table(contigs, "contig_idx", "seq").select("contig_idx", S.frequencies(F.col("counts")).alias("freqs"))
    else:
        freqs = contigs.select("contig", "contig_idx").join(kmers, "contig").select("contig_idx", "freqs")
    tnf = freqs.select("contig_idx", S.log_ratio(F.col("freqs"), options.pseudo_count).alias("x"))
    tnf = tnf.withColumn("x", let(total(F.col("x")) / F.size("x"), lambda m: F.transform("x", lambda v: v - m)))
    unit = let(F.sqrt(total(F.transform("x", lambda v: v * v))), lambda n: F.transform("x", lambda v: F.coalesce(F.try_divide(v, n), F.lit(0.0))))
    profiles = tnf.select("contig_idx", F.coalesce(unit, F.array_repeat(F.lit(0.0), 136)).alias("profile"))
    return cov.join(profiles, "contig_idx").select(F.col("contig_idx").alias("id"), F.concat(means, "profile").alias("vec"))


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    opts = options(args)
    spark = build_session(args.master)
    sinks.guard(spark, args.output_directory)
    kmers = tables.read_kmers(spark, args.kmer_frequency_file) if args.kmer_frequency_file else None
    if args.command == "recover":
        contigs = sequences.read_contigs(spark, args.assembly)
        long, samples = coverage(spark, args, contigs)
        if args.write_coverage:
            sinks.write_coverage(long, samples, args.write_coverage)
        metrics_to = (lambda table: sinks.write_metrics(table, args.metrics)) if args.metrics else None
        bins = R.recover(contigs, long, samples, opts, to_refine=not args.skip_refine, metrics_to=metrics_to, kmers=kmers)
        tag = "refined_0"
    else:
        rows = sequences.read_bins(spark, args.genome_files or args.genome_directory, args.extension)
        contigs = rows.select(F.xxhash64("bin", "contig").alias("contig_idx"), "contig", "seq", "contig_len", "bin")
        long, samples = coverage(spark, args, contigs)
        bins, tag = contigs.select("bin", "contig_idx", "contig", "seq"), args.bin_tag
    if args.command == "refine" or not args.skip_refine:
        bins = cut(bins)
        sized = bins.select("bin", "contig_idx", F.length("seq").cast("long").alias("contig_len"))
        better = R.refine(sized, bin_vectors(contigs, long, samples, opts, kmers), opts, tag)
        bins = better.select("contig_idx", "bin").join(bins.drop("bin"), "contig_idx")
    staged = f"{args.output_directory.rstrip('/')}.staged"
    sinks.write_bins(bins, staged, refuse=False)
    sinks.publish(spark, [staged], args.output_directory)


if __name__ == "__main__":
    main()
