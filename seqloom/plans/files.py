"""Queries of the sources and sinks: tables of the folder are written in a file format and read back from it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import depth
from seqloom.plans.relational import _LAST, _LONG, _REGISTER, _SEQ, _contigs, _long, _members, _register, _whole
from seqloom.session import cut, read, shared_dir
from seqloom.sources import sequences, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


_RECORDS = f"with {_SEQ} select 'doc' || doc_id as contig, coalesce(seq, '') as seq, cast(length(coalesce(seq, '')) as bigint) as contig_len from s"


def _named(spark: SparkSession, d: str) -> DataFrame:
    return _contigs(spark, d).select(F.concat(F.lit("doc"), "doc_id").alias("contig"), F.coalesce("seq", F.lit("")).alias("seq"), "doc_id")


@query(_RECORDS)
def fasta_scan(spark: SparkSession, d: str) -> DataFrame:
    """The documents' letters as FASTA of wrapped lines and CRLF."""
    where, rows = _place(spark), _named(spark, d)
    wrapped = F.regexp_replace("seq", "(.{60})", "$1\r\n")
    rows.select(F.concat(F.lit(">"), "contig", F.lit(" of a page\r\n"), wrapped).alias("value")).write.text(where)
    return sequences.read_contigs(spark, where).select("contig", "seq", "contig_len")


@query(_RECORDS)
def fastq_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same in FASTQ beside FASTA: each file is read by its own kind."""
    where, rows = _place(spark), _named(spark, d)
    quality = F.repeat(F.lit("I"), F.length("seq"))
    rows.where("doc_id % 2 = 0").select(F.concat(F.lit("@"), "contig", F.lit("\n"), "seq", F.lit("\n+\n"), quality).alias("value")).write.text(f"{where}/q")
    rows.where("doc_id % 2 <> 0").select(F.concat(F.lit(">"), "contig", F.lit("\n"), "seq").alias("value")).write.text(f"{where}/a")
    return sequences.read_contigs(spark, where).select("contig", "seq", "contig_len")


@query(_RECORDS.replace("select 'doc'", "select 'bin_' || coalesce(doc_id % 7, 0) as bin, 'doc'"))
def bins_scan(spark: SparkSession, d: str) -> DataFrame:
    """Bins written, published and read again."""
    where = _place(spark)
    rows = _named(spark, d).select(F.concat(F.lit("bin_"), F.coalesce(F.col("doc_id") % 7, F.lit(0))).alias("bin"), F.col("doc_id").alias("contig_idx"), "contig", "seq")
    sinks.write_bins(rows, f"{where}.staged", part_bytes=20_000)
    sinks.publish(spark, [f"{where}.staged"], where)
    return sequences.read_bins(spark, where).select("bin", "contig", "seq", "contig_len")


def _coverage_sql(long_read: bool) -> str:
    length = "" if long_read else ", max(contig_len) over (partition by contig) as contig_len"
    return f"""with {_LONG}, n as (select contig, sample_name, round(mean, 3) as mean, round(coalesce(var, 0), 3) as var{length} from l),
      c as (select contig{"" if long_read else ", max(contig_len) as contig_len"} from n group by 1)
      select c.*, s.sample_name, coalesce(n.mean, 0.0) as mean, coalesce(n.var, 0.0) as var
      from c cross join (select distinct sample_name from l) s left join n on n.contig = c.contig and n.sample_name = s.sample_name"""


def _samples(long: DataFrame) -> list[str]:
    return sorted(r[0] for r in long.select("sample_name").distinct().collect())  # the samples of a header


def _rounded(long: DataFrame) -> DataFrame:
    return long.withColumn("mean", F.round("mean", 3)).withColumn("var", F.round("var", 3))


@query(_coverage_sql(False))
def coverage_scan(spark: SparkSession, d: str) -> DataFrame:
    """The coverage table written wide with three decimals and read again in long form."""
    where, long = _place(spark), cut(_rounded(_long(spark, d)))
    sinks.write_coverage(long, _samples(long), where)
    return tables.read_coverage(spark, where)


@query(_coverage_sql(True))
def long_read_coverage_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same as a table of long reads, which repeats the length for every sample."""
    where, long = _place(spark), cut(_rounded(_long(spark, d)))
    samples = _samples(long)
    wide = sinks.formatted_coverage(long, samples)
    cells = [x for s in samples for x in (F.col("contigLen").alias(f"{s}-len"), F.col(f"`{s}`"), F.col(f"`{s}-var`"))]
    # name, then length, mean and variance of each sample; the mean's header names the sample
    wide.select("contigName", *cells).write.option("sep", "\t").option("header", True).csv(where)
    return tables.read_long_read_coverage(spark, where).drop("contig_len")


@query("""with t as (select tnf_id, freqs from tnf_vec where len(freqs) = 136 and len(list_filter(freqs, lambda x: x is null or isnan(x))) = 0)
  select cast(tnf_id as varchar) as contig, freqs from t""")
def kmer_scan(spark: SparkSession, d: str) -> DataFrame:
    """The k-mer table as comma separated text and back."""
    where = _place(spark)
    sinks.write_kmers(_whole(spark, d).select(F.col("tnf_id").cast("string").alias("contig"), "freqs"), where)
    return tables.read_kmers(spark, where)


@query(f"with {_LAST} select run_id * 100000 + label as label, contig_idx from m where label is not null")
def cluster_scan(spark: SparkSession, d: str) -> DataFrame:
    """Cluster maps as JSON files and back; a file holds a bounded part of one bin."""
    where = _place(spark)
    rows = _members(spark, d).where("label is not null").select((F.col("run_id") * 100_000 + F.col("label")).alias("label"), "contig_idx", F.pmod(F.xxhash64("contig_idx"), F.lit(64)).alias("part"))
    maps = rows.groupBy("label", "part").agg(F.collect_list("contig_idx").alias("members")).select(F.to_json(F.create_map(F.col("label").cast("string"), "members")).alias("value"))
    maps.write.text(where)
    return tables.explode_clusters(tables.read_lines(spark, where), "value")


_READS = f"""{_REGISTER}, a as (select contig, contig_len, greatest(contig_len - 100, 0) // 2 as start, least(contig_len, 100) as n from c where contig <> '' and contig_len > 0),
  u as (select contig, max(contig_len) as contig_len from a group by 1),
  x as (select contig, contig_len, greatest(contig_len - 100, 0) // 2 as start, least(contig_len, 100) as n from u)"""


@query(f"""with {_READS} select contig, contig_len, round((n + n // 2) / contig_len, 9) as mean,
    round(case when contig_len > 1 then greatest((n + 3 * (n // 2) - (n + n // 2) * (n + n // 2)::double / contig_len) / (contig_len - 1), 0.0) else 0.0 end, 9) as var from x""")
def sam_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depths of every contig from SAM text of two alignments each: its middle hundred letters, and the first half of these again."""
    where = _place(spark)
    sized = cut(_register(spark, d).where("contig <> '' and contig_len > 0").groupBy("contig").agg(F.max("contig_len").alias("contig_len")))
    n = F.least("contig_len", F.lit(100))
    start = F.floor(F.greatest(F.col("contig_len") - 100, F.lit(0)) / 2) + 1
    rows = sized.select("contig", start.alias("start"), F.explode(F.array(n, F.floor(n / 2))).alias("n")).where("n > 0")
    cells = (F.lit("read"), F.lit("0"), "contig", F.col("start").cast("string"), F.lit("60"), F.concat(F.col("n").cast("string"), F.lit("M2S")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"))
    rows.select(F.concat_ws("\t", *cells).alias("value")).write.text(where)
    found = depth.coverage_of(depth.read_sam(spark, where), sized)
    return found.select("contig", "contig_len", F.round("mean", 9).alias("mean"), F.round("var", 9).alias("var"))
