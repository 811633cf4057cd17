"""Queries of the relational operators: sequences, coverage tables, clusterings; each with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import distances as D
from seqloom.functions import sequences as S
from seqloom.operators import assignments as A
from seqloom.operators import tables as T
from seqloom.session import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
EVENTS = ("click", "error", "purchase", "signup", "view")
LEAST_CONTIG, LEAST_BIN, LEAST_COUNT = 1500, 200_000, 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- sequences: a document's letters A, C, G, T are a contig ---


def _contigs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", S.only_bases(F.col("text")).alias("seq"))


_SEQ = "s as (select doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') as seq from documents)"
_RC = "translate(reverse({0}), 'ACGT', 'TGCA')"
_WORDS = f"""b as (select unnest(['A', 'C', 'G', 'T']) as x),
w as (select p.x || q.x || r.x || t.x as k from b p, b q, b r, b t),
dict as (select kmer, row_number() over (order by kmer) - 1 as kmer_id from (select distinct least(k, {_RC.format("k")}) as kmer from w))"""
_COUNTS = f"""{_SEQ},
k as (select doc_id, substr(seq, i, 4) as k from (select doc_id, seq, unnest(range(1, length(seq) - 2)) as i from s)),
c as (select doc_id, least(k, {_RC.format("k")}) as kmer, count(*) as n from k group by 1, 2)"""


@query(f"with {_SEQ} select doc_id, {_RC.format('seq')} as rc from s")
def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return _contigs(spark, d).select("doc_id", S.reverse_complement(F.col("seq")).alias("rc"))


@query(f"with {_WORDS} select cast(kmer_id as int) as kmer_id, kmer from dict")
def kmer_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return S.kmer_dictionary(spark)


@query(f"with {_COUNTS} select doc_id, kmer, n from c")
def tnf_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.long_counts(S.kmer_table(_contigs(spark, d), "doc_id", "seq"), "doc_id")


@query(f"with {_COUNTS} select doc_id, kmer, n / sum(n) over (partition by doc_id) as freq from c")
def tnf_freq(spark: SparkSession, d: str) -> DataFrame:
    table = S.kmer_table(_contigs(spark, d), "doc_id", "seq").select("doc_id", S.frequencies(F.col("counts")).alias("counts"))
    names = F.array(*map(F.lit, S.dictionary()[0]))
    return table.select("doc_id", F.posexplode("counts").alias("i", "freq")).where("freq > 0").select("doc_id", F.get(names, F.col("i")).alias("kmer"), "freq")


@query(f"with {_WORDS}, {_COUNTS} select s.doc_id, dict.kmer, coalesce(c.n, 0) as n from s cross join dict left join c on c.doc_id = s.doc_id and c.kmer = dict.kmer")
def tnf_dense(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, S.dictionary()[0]))
    table = S.kmer_table(_contigs(spark, d), "doc_id", "seq")
    return table.select("doc_id", F.posexplode("counts").alias("i", "n")).select("doc_id", F.get(names, F.col("i")).alias("kmer"), "n")


def _whole(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "tnf_vec").where(F.size("freqs") == 136)
    return rows.where(F.forall("freqs", lambda x: x.isNotNull() & ~F.isnan(x)))


_WHOLE = "t as (select * from tnf_vec where len(freqs) = 136 and len(list_filter(freqs, lambda x: x is null or isnan(x))) = 0)"


@query(f"""with {_WHOLE}, m as (select *, list_sum(freqs) / 136 as mean from t)
  select tnf_id, cast(i as int) as i, case when freqs[i + 1] = 0 then '-Infinity'::double else round(ln(freqs[i + 1] / mean), 6) end as v
  from (select *, unnest(range(136)) as i from m)""")
def clr_transform(spark: SparkSession, d: str) -> DataFrame:
    each = _whole(spark, d).select("tnf_id", F.posexplode(S.log_ratio(F.col("freqs"))).alias("i", "v"))
    return each.select("tnf_id", "i", F.when(F.col("v") == float("-inf"), F.col("v")).otherwise(F.round("v", 6)).alias("v"))


@query("select tnf_id, cast(round(ln(len(freqs)) / ln(4)) as int) as k from tnf_vec where len(freqs) > 0")
def infer_k(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "tnf_vec").where(F.size("freqs") > 0).select("tnf_id", S.kmer_size(F.size("freqs")).alias("k"))


@query(f"with {_WHOLE} select tnf_id, round(list_sum(freqs), 6) as total, round(list_sum(freqs) / 136, 9) as mean from t")
def row_stats(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("freqs", F.lit(0.0), lambda s, x: s + x)
    return _whole(spark, d).select("tnf_id", F.round(total, 6).alias("total"), F.round(total / 136, 9).alias("mean"))


_MIX_1 = f"(({{0}}::uhugeint * {S.MIX_A}::uhugeint) % 18446744073709551616::uhugeint)::ubigint"
_MIX_2 = f"((xor({{0}}, {{0}} >> 32)::uhugeint * {S.MIX_B}::uhugeint) % 18446744073709551616::uhugeint)::ubigint"


@query(rf"""with {_SEQ}, w as (select doc_id, substr(seq, i, 31) as w from (select doc_id, seq, unnest(range(1, length(seq) - 29)) as i from s)),
  d as (select doc_id, list_transform(string_split(w, ''), lambda x: instr('ACGT', x) - 1) as d from w),
  p as (select doc_id, list_sum(list_transform(range(1, 32), lambda i: d[i]::hugeint * (1::hugeint << (62 - 2 * i)::integer)))::ubigint as f,
    list_sum(list_transform(range(1, 32), lambda i: (3 - d[i])::hugeint * (1::hugeint << (2 * i - 2)::integer)))::ubigint as r from d),
  a as (select doc_id, {_MIX_1.format("least(f, r)")} as h from p), b as (select doc_id, {_MIX_2.format("h")} as h from a), c as (select doc_id, xor(h, h >> 29) as h from b),
  k as (select doc_id, count(*) as n_kmers, count(distinct h) filter (h >> 1 < {int(0.1 * float(1 << 63))}) as n_hashes, min(h >> 1)::bigint as least_hash from c group by 1)
  select doc_id, cast(length(seq) as int) as seq_length, coalesce(n_kmers, 0) as n_kmers, cast(coalesce(n_hashes, 0) as int) as n_hashes,
    case when least_hash < {int(0.1 * float(1 << 63))} then least_hash end as least_hash from s left join k using (doc_id) where seq is not null""")
def doc_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Scaled sketches of the documents' 31-mers: their sizes, and the least hash without its last bit."""
    least = F.array_min(F.transform("hashes", lambda h: F.shiftrightunsigned(h, 1)))
    rows = S.scaled_sketch(_contigs(spark, d).where("seq is not null"), "doc_id", "seq")
    return rows.select("doc_id", "seq_length", "n_kmers", F.size("hashes").alias("n_hashes"), least.alias("least_hash"))


# --- coverage tables ---

_LONG = r"""l as (
  select contig, contig_len, sample_name, mean, var from (
    select regexp_extract(contig, '(\S+)', 1) as contig, contig_len, sample_name, mean_depth as mean, case when isnan(var_depth) then null else var_depth end as var,
      row_number() over (partition by regexp_extract(contig, '(\S+)', 1), sample_name order by received_at desc nulls last, cov_id desc) as n
    from coverage where mean_depth is not null and not isnan(mean_depth) and sample_name is not null and regexp_extract(contig, '(\S+)', 1) <> '')
  where n = 1)"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    return T.long_coverage(read(spark, d, "coverage"))


@query(f"with {_LONG} select * from l")
def coverage_latest(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d)


def _events(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").where("value is not null")
    return rows.groupBy(F.col("user_id").alias("contig"), F.col("event_type").alias("sample_name")).agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


_EVENTS = "e as (select user_id as contig, event_type as sample_name, avg(value) as mean, var_samp(value) as var from events where value is not null group by 1, 2)"


@query(f"with {_EVENTS} select contig, " + ", ".join(f"round(max({v}) filter (sample_name = '{s}'), 6) as {s}_{v}" for s in EVENTS for v in ("mean", "var")) + " from e group by 1")
def coverage_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = T.wide_coverage(_events(spark, d), EVENTS)
    return wide.select("contig", *(F.round(f"{s}_{v}", 6).alias(f"{s}_{v}") for s in EVENTS for v in ("mean", "var")))


@query(f"with {_EVENTS} select contig, sample_name, format('{{:.3f}}', round(mean, 3)) as mean from e")
def three_decimals(spark: SparkSession, d: str) -> DataFrame:
    """Numbers are rounded as numbers before they are printed, so that ties print alike everywhere."""
    return _events(spark, d).select("contig", "sample_name", F.format_string("%.3f", F.round("mean", 3)).alias("mean"))


@query(f"with {_LONG} select contig, round(avg(mean), 11) as avg_depth, count(*) as n_samples from l group by 1")
def avg_depth(spark: SparkSession, d: str) -> DataFrame:
    return T.average_depth(_long(spark, d)).withColumn("avg_depth", F.round("avg_depth", 11))


@query(f"with {_LONG} select contig, round(avg(mean), 11) as avg_depth, count(*) as n_samples from l group by 1")
def coverage_merge(spark: SparkSession, d: str) -> DataFrame:
    """Three tables of different samples, merged, and the average taken again over all samples."""
    long = _long(spark, d)
    kind = F.pmod(F.ascii("sample_name"), F.lit(3))
    merged = T.merge([long.where(kind == i) for i in range(3)])
    return T.average_depth(merged).withColumn("avg_depth", F.round("avg_depth", 11))


@query(f"""with {_LONG}, a as (select distinct contig from l where ascii(sample_name) % 2 = 0), b as (select distinct contig from l where ascii(sample_name) % 2 = 1)
  (select contig from a except select contig from b) union all (select contig from b except select contig from a)""")
def merge_mismatch(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d)
    even = F.pmod(F.ascii("sample_name"), F.lit(2)) == 0
    return T.contig_mismatch(long.where(even), long.where(~even))


@query(f"select contig_idx, contig, contig_len from contigs where contig_len >= {LEAST_CONTIG}")
def filter_by_length(spark: SparkSession, d: str) -> DataFrame:
    return T.by_length(read(spark, d, "contigs"), "contig_len", LEAST_CONTIG)[0].select("contig_idx", "contig", "contig_len")


@query(f"select contig_idx, contig from contigs where contig_len < {LEAST_CONTIG} or contig_len is null")
def filtered_names(spark: SparkSession, d: str) -> DataFrame:
    return T.by_length(read(spark, d, "contigs"), "contig_len", LEAST_CONTIG)[1].select("contig_idx", "contig")


@query("select tnf_id, contig_idx from tnf_vec where contig_idx not in (select contig_idx from membership where label is null and contig_idx is not null)")
def filter_by_index(spark: SparkSession, d: str) -> DataFrame:
    outliers = read(spark, d, "membership").where("label is null")
    return T.without(read(spark, d, "tnf_vec"), outliers, "contig_idx").select("tnf_id", "contig_idx")


@query(r"""select tnf_id from tnf_vec t where regexp_extract(t.contig, '(\S+)', 1) not in
  (select regexp_extract(contig, '(\S+)', 1) from contigs where removed_at is not null and contig is not null) or t.contig is null""")
def filter_by_name(spark: SparkSession, d: str) -> DataFrame:
    name = T.first_token(F.col("contig")).alias("name")
    gone = read(spark, d, "contigs").where("removed_at is not null").select(name)
    return T.without(read(spark, d, "tnf_vec").select("tnf_id", name), gone, "name").select("tnf_id")


@query(r"select distinct contig_idx, regexp_extract(contig, '(\S+)', 1) as name from contigs where contig_idx in (select contig_idx from sketch)")
def names_for_index(spark: SparkSession, d: str) -> DataFrame:
    kept = T.only(read(spark, d, "contigs"), read(spark, d, "sketch"), "contig_idx")
    return kept.select("contig_idx", T.first_token(F.col("contig")).alias("name")).distinct()


@query(r"""with h as (select distinct regexp_extract(replace(regexp_extract(sample_name, '([^/]*)$', 1), '.bam', ''), '(\S+)', 1) as s from coverage where sample_name is not null)
  select sample_name from samples where sample_name is null or regexp_extract(replace(regexp_extract(sample_name, '([^/]*)$', 1), '.bam', ''), '(\S+)', 1) not in (select s from h)""")
def missing_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of the manifest without any coverage row."""
    return T.missing_samples(read(spark, d, "samples"), read(spark, d, "coverage")).select("sample_name")


@query("select sample_name, kind, path1, path2 from samples where kind in ('paired', 'coupled')")
def samples_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return T.of_kinds(read(spark, d, "samples"), ["paired", "coupled"]).select("sample_name", "kind", "path1", "path2")


@query(r"""with h as (select distinct regexp_extract(replace(regexp_extract(sample_name, '([^/]*)$', 1), '.bam', ''), '(\S+)', 1) as s from coverage where sample_name is not null)
  select sample_name, kind from samples where kind in ('paired', 'short_bam', 'long_bam')
    and regexp_extract(replace(regexp_extract(sample_name, '([^/]*)$', 1), '.bam', ''), '(\S+)', 1) in (select s from h)""")
def samples_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Samples of some kinds that have coverage."""
    return T.of_kinds(read(spark, d, "samples"), ["paired", "short_bam", "long_bam"], read(spark, d, "coverage")).select("sample_name", "kind")


@query("select kind, count(*) as n_samples, count(path2) as n_second from samples group by 1")
def n_samples(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "samples").groupBy("kind").agg(F.count(F.lit(1)).alias("n_samples"), F.count("path2").alias("n_second"))


@query("select file_id, regexp_extract(path1, '([^/]*)$', 1) as file_name, contains(path1, 'batch1') as in_batch from coverage_files")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "coverage_files").select("file_id", A.file_name(F.col("path1")).alias("file_name"), A.name_contains(F.col("path1"), "batch1").alias("in_batch"))


@query(r"""with h as (select file_id, string_split(regexp_replace(raw_line, '\r$', ''), chr(9)) as c from coverage_lines where line_no = 1)
  select file_id, cast(i as int) as sample_no, regexp_extract(replace(regexp_extract(c[2 * i + 2], '([^/]*)$', 1), '.bam', ''), '(\S+)', 1) as sample_name
  from (select *, unnest(range(1, len(c) // 2)) as i from h)""")
def header_samples(spark: SparkSession, d: str) -> DataFrame:
    cells = F.split(F.regexp_replace("raw_line", "\r$", ""), "\t")
    heads = read(spark, d, "coverage_lines").where("line_no = 1").select("file_id", cells.alias("c"))
    firsts = F.filter(F.col("c"), lambda x, i: (i >= 3) & (i % 2 == 1) & (i + 1 <= F.size("c")))
    each = heads.select("file_id", F.size("c").alias("n"), F.posexplode(firsts).alias("k", "cell"))
    return each.where(F.col("k") + 1 < F.floor(F.col("n") / 2)).select("file_id", (F.col("k") + 1).alias("sample_no"), T.sample_name(F.col("cell")).alias("sample_name"))


@query("select source, case when max_repeats >= 1 then max_repeats / 100 else max_repeats end as share, target_share as same from mix_targets")
def percentages(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "mix_targets")
    return rows.select("source", D.percentage(F.col("max_repeats").cast("double")).alias("share"), D.percentage(F.col("target_share")).alias("same"))


@query(rf"""with {_LONG}, a as (select contig, avg(mean) as avg_depth from l group by 1),
  t as (select regexp_extract(contig, '(\S+)', 1) as contig, min(tnf_id) as tnf_id from tnf_vec where contig is not null group by 1),
  s as (select regexp_extract(contig, '(\S+)', 1) as contig, min(sketch_id) as sketch_id from sketch where contig is not null group by 1)
  select contig, round(avg_depth, 11) as avg_depth, tnf_id, sketch_id from a join t using (contig) join s using (contig)""")
def feature_join(spark: SparkSession, d: str) -> DataFrame:
    name = T.first_token(F.col("contig")).alias("contig")

    def first(t: str, i: str) -> DataFrame:
        return read(spark, d, t).where("contig is not null").select(name, i).groupBy("contig").agg(F.min(i).alias(i))

    joined = T.feature_join(T.average_depth(_long(spark, d)), first("tnf_vec", "tnf_id"), first("sketch", "sketch_id"))
    return joined.select("contig", F.round("avg_depth", 11).alias("avg_depth"), "tnf_id", "sketch_id")


# --- clusterings ---

_LAST = """m as (
  select run_id, contig_idx, label, contig_len from (
    select *, row_number() over (partition by run_id, contig_idx order by assigned_at desc nulls last, coalesce(label, -1), contig_len desc nulls last) as n from membership)
  where n = 1)"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_assignments(read(spark, d, "membership"))


_SIZES = f"{_LAST}, z as (select run_id, label, count(*) as n_contigs, cast(coalesce(sum(contig_len), 0) as bigint) as bin_size from m where label is not null group by 1, 2)"


@query(f"with {_SIZES} select * from z")
def bin_sizes(spark: SparkSession, d: str) -> DataFrame:
    return A.bin_sizes(_members(spark, d))


@query(f"""with {_LAST} select run_id, label, count(*) filter (contig_len >= {LEAST_CONTIG}) as n_long, cast(coalesce(sum(contig_len) filter (contig_len >= {LEAST_CONTIG}), 0) as bigint) as long_size,
  count(*) filter (contig_len >= {LEAST_CONTIG}) >= {LEAST_COUNT} and coalesce(sum(contig_len) filter (contig_len >= {LEAST_CONTIG}), 0) >= {LEAST_BIN} as passes
  from m where label is not null group by 1, 2""")
def bin_requirements(spark: SparkSession, d: str) -> DataFrame:
    return A.requirements(_members(spark, d), ("run_id", "label"), LEAST_CONTIG, LEAST_COUNT, LEAST_BIN)


@query(f"with {_SIZES} select run_id, contig_idx, label, case when bin_size >= {LEAST_BIN} and label <> 0 then label end as kept_label from m left join z using (run_id, label)")
def bin_size_gate(spark: SparkSession, d: str) -> DataFrame:
    return A.gate_by_size(_members(spark, d), ("run_id", "label"), LEAST_BIN).select("run_id", "contig_idx", "label", "kept_label")


@query(f"with {_SIZES} select run_id, contig_idx, label, case when bin_size < {LEAST_BIN} then 0 else label end as folded_label from m left join z using (run_id, label)")
def fold_small_bins(spark: SparkSession, d: str) -> DataFrame:
    return A.fold_small(_members(spark, d), ("run_id", "label"), LEAST_BIN).select("run_id", "contig_idx", "label", "folded_label")


@query(f"""with {_LAST}, f as (select run_id, label, min(contig_idx) as least from m where label is not null group by 1, 2),
  r as (select run_id, label, cast(row_number() over (partition by run_id order by least, label) - 1 as int) as dense_label from f)
  select m.run_id, m.contig_idx, r.dense_label from m left join r on m.run_id = r.run_id and m.label = r.label""")
def dense_relabel(spark: SparkSession, d: str) -> DataFrame:
    return A.dense_labels(_members(spark, d)).select("run_id", "contig_idx", "dense_label")


@query(f"with {_LAST} select run_id, label, cast(row_number() over (order by run_id, label) as int) as global_label from (select distinct run_id, label from m where label is not null)")
def global_labels(spark: SparkSession, d: str) -> DataFrame:
    return A.offset_labels(_members(spark, d), "run_id", "label")


_TWO = f"""{_LAST}, a as (select label, contig_idx from m where run_id = 1), b as (select label, contig_idx from m where run_id = 2),
  r as (select label, cast(row_number() over (order by label) + (select max(label) from a) as int) as new_label from (select distinct label from b where label is not null))"""


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = _members(spark, d)
    return m.where("run_id = 1").select("label", "contig_idx"), m.where("run_id = 2").select("label", "contig_idx")


@query(f"with {_TWO} select label, contig_idx from a where label is not null union all select r.new_label, b.contig_idx from b left join r on b.label = r.label")
def merge_clusterings(spark: SparkSession, d: str) -> DataFrame:
    return A.merge_clusterings(*_runs(spark, d))


@query(f"with {_TWO} select label, contig_idx from a union all select r.new_label, b.contig_idx from b join r on b.label = r.label")
def append_clusters(spark: SparkSession, d: str) -> DataFrame:
    return A.append_clusters(*_runs(spark, d))


@query(f"""with {_LAST}, k as (select run_id, label, contig_idx, case when label % 7 = 0 then null else label % 5 end as s from m where label is not null),
  g as (select *, case when s is null then 1 else 0 end as alone, coalesce(s, label) as key from k),
  o as (select run_id, alone, key, cast(row_number() over (partition by run_id order by alone, min(label)) - 1 as int) as merged_label from g group by 1, 2, 3)
  select run_id, o.merged_label, g.contig_idx from g join o using (run_id, alone, key)""")
def super_merge(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of every run united by a super-cluster of their labels."""
    members = _members(spark, d).select("run_id", "label", "contig_idx")
    supers = members.where("label is not null and label % 7 <> 0").select("run_id", "label", (F.col("label") % 5).alias("super_label")).distinct()
    return A.merge_by_super_clusters(members, supers, ("run_id",))


@query(f"""with {_SIZES} select run_id, contig_idx, m.label, case when m.label is null then case when contig_len >= 10000 then 'single' else 'outlier' end
  when bin_size >= 1000000 then 'large' else 'cluster' end as part from m left join z using (run_id, label)""")
def split_large(spark: SparkSession, d: str) -> DataFrame:
    return A.split_by_size(_members(spark, d), 1_000_000, 10_000, keys=("run_id", "label")).select("run_id", "contig_idx", "label", "part")


@query(f"""with {_LAST}, x as (select run_id, count(distinct contig_idx) as n from membership group by 1)
  select run_id, count(label) as n_clustered, count(*) - count(label) as n_outliers, x.n as n_expected, count(*) = x.n as conserved from m join x using (run_id) group by run_id, x.n""")
def conservation_check(spark: SparkSession, d: str) -> DataFrame:
    # contigs per run, counted over the distinct pairs
    expected = read(spark, d, "membership").select("run_id", "contig_idx").distinct().groupBy("run_id").agg(F.count("contig_idx").alias("n_expected"))
    return A.conservation(_members(spark, d), expected)


@query(f"with {_LAST} select run_id, avg(case when label is null then 1.0 else 0.0 end) as outlier_share from m group by 1")
def outlier_fraction(spark: SparkSession, d: str) -> DataFrame:
    return A.outlier_share(_members(spark, d))


_REGISTER = r"c as (select contig_idx, max(regexp_extract(contig, '(\S+)', 1)) as contig, max(contig_len) as contig_len from contigs where contig_idx is not null group by 1)"


def _register(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "contigs").where("contig_idx is not null")
    return rows.groupBy("contig_idx").agg(F.max(T.first_token(F.col("contig"))).alias("contig"), F.max("contig_len").alias("contig_len"))


@query(f"with {_LAST}, {_REGISTER} select m.run_id, c.contig_idx, c.contig, m.label from c join m using (contig_idx)")
def assembly_assignments(spark: SparkSession, d: str) -> DataFrame:
    return _register(spark, d).select("contig_idx", "contig").join(_members(spark, d).select("run_id", "contig_idx", "label"), "contig_idx").select("run_id", "contig_idx", "contig", "label")


@query(f"with {_LAST}, {_REGISTER} select distinct m.run_id, m.label, c.contig from m join c using (contig_idx) where m.label is not null and c.contig is not null")
def bin_contig_names(spark: SparkSession, d: str) -> DataFrame:
    """The distinct names of every bin's contigs."""
    return A.bin_names_of(_members(spark, d), _register(spark, d).select("contig_idx", "contig"))


@query(f"""with {_LAST}, {_REGISTER}, {_LONG}, a as (select contig, avg(mean) as depth from l group by 1)
  select m.run_id, m.label, count(*) as n_measured, round(avg(a.depth), 11) as depth from m join c using (contig_idx) join a using (contig) where m.label is not null group by 1, 2""")
def bin_depths(spark: SparkSession, d: str) -> DataFrame:
    """Average depth of every bin's measured contigs, joined by contig and never by position."""
    named = _members(spark, d).where("label is not null").select("run_id", "label", "contig_idx").join(_register(spark, d).select("contig_idx", "contig"), "contig_idx")
    joined = named.join(T.average_depth(_long(spark, d)), "contig")
    return joined.groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("n_measured"), F.round(F.avg("avg_depth"), 11).alias("depth"))


@query(f"""with {_LAST}, {_REGISTER}, x as (
    select r.run_id, c.contig_idx, coalesce(c.contig_len, 0) as len, m.label from c cross join (select distinct run_id from m) r left join m on m.run_id = r.run_id and m.contig_idx = c.contig_idx),
  k as (select *, case when len < {LEAST_CONTIG} and len < 30000 then 'small_unbinned' when len >= {LEAST_CONTIG} and label is not null then cast(label as varchar) when len >= 30000 then 'single' else 'unbinned' end as kind from x),
  n as (select run_id, contig_idx, row_number() over (partition by run_id order by contig_idx) as n from k where kind = 'single')
  select run_id, contig_idx, 'bin_' || case when kind = 'single' then 'single_contig_' || n else kind end as bin from k left join n using (run_id, contig_idx)""")
def bin_naming(spark: SparkSession, d: str) -> DataFrame:
    """Bin names of every run, each with all contigs of the register."""
    labels = _members(spark, d).select("run_id", "contig_idx", "label")
    every = _register(spark, d).crossJoin(labels.select("run_id").distinct())
    return A.bin_names(every.join(labels, ["run_id", "contig_idx"], "left"), LEAST_CONTIG, 30_000, keys=("run_id",))


@query(r"""select contig_idx, row_number() over (order by added_at, contig_idx, contig) - 1 as row_index from contigs""")
def contig_index(spark: SparkSession, d: str) -> DataFrame:
    return T.row_index(read(spark, d, "contigs").select("contig_idx", "added_at", "contig"), ["added_at", "contig_idx", "contig"]).select("contig_idx", "row_index")


@query(f"""with {_LAST}, g as (select run_id, label, count(distinct contig_idx % 3) as k from m where label is not null group by 1, 2)
  select run_id, label, k > 1 as changed from g""")
def refine_decision(spark: SparkSession, d: str) -> DataFrame:
    """Which bins of all runs a split by index modulo three would change."""
    bins = _members(spark, d).where("label is not null").select("run_id", F.col("label").alias("bin"), "contig_idx", "contig_len")
    back = bins.withColumn("label", (F.col("contig_idx") % 3).cast("int"))
    originals = bins.groupBy("run_id", "bin").agg(F.count(F.lit(1)).alias("n_contigs"))
    return A.refine_decision(back, originals, LEAST_BIN, keys=("run_id", "bin")).withColumnRenamed("bin", "label")


@query(f"with {_LAST} select run_id, label, contig_idx from m where label is not null")
def cluster_json(spark: SparkSession, d: str) -> DataFrame:
    """Cluster maps as JSON text by run and label, read back."""
    # a bin's members travel in lists of bounded length: a map per label and part
    rows = _members(spark, d).where("label is not null").withColumn("part", F.pmod(F.xxhash64("contig_idx"), F.lit(64)))
    text = rows.groupBy("run_id", "label", "part").agg(F.to_json(F.map_from_arrays(F.array(F.first(F.col("label").cast("string"))), F.array(F.collect_list("contig_idx")))).alias("json"))
    parsed = text.select("run_id", F.explode(F.from_json("json", "map<string,array<bigint>>")).alias("label", "members"))
    return parsed.select("run_id", F.col("label").cast("int").alias("label"), F.explode("members").alias("contig_idx"))


@query("""select run_id, label as min_cluster_size, n as min_samples, s as score from (
    select run_id, label, cast(n_contigs as int) as n, cast(case when embed_dist is null or cast(embed_dist as varchar) = 'nan' then 0 else embed_dist end as double) as s,
      row_number() over (partition by run_id order by case when embed_dist is null or cast(embed_dist as varchar) = 'nan' then 0 else embed_dist end desc, label, n_contigs) as r from bin_metrics)
  where r = 1""")
def best_of_grid(spark: SparkSession, d: str) -> DataFrame:
    """The best row of each run's score table; labels and counts stand for the grid's parameters."""
    scores = read(spark, d, "bin_metrics").select("run_id", F.col("label").alias("min_cluster_size"), F.col("n_contigs").cast("int").alias("min_samples"), F.col("embed_dist").cast("double").alias("score"))
    return A.best_of_grid(scores, ("run_id",))


@query(r"""select regexp_extract(contig, '(\S+)', 1) as name from contigs where contig is not null union select regexp_extract(contig, '(\S+)', 1) from tnf_vec where contig is not null""")
def union_names(spark: SparkSession, d: str) -> DataFrame:
    name = T.first_token(F.col("contig")).alias("name")
    parts = [read(spark, d, t).where("contig is not null").select(name) for t in ("contigs", "tnf_vec")]
    return parts[0].union(parts[1]).distinct()


@query(r"""select distinct regexp_extract(contig, '(\S+)', 1) as name from contigs where contig is not null except select regexp_extract(contig, '(\S+)', 1) from tnf_vec where contig is not null""")
def name_difference(spark: SparkSession, d: str) -> DataFrame:
    name = T.first_token(F.col("contig")).alias("name")
    a, b = (read(spark, d, t).where("contig is not null").select(name).distinct() for t in ("contigs", "tnf_vec"))
    return T.without(a, b, "name")


@query(r"""select sample_name, strftime(time_bucket(interval 7 days, measured_at, timestamp '1970-01-01'), '%Y-%m-%d') as week, round(avg(mean_depth), 11) as mean_depth, count(*) as n_rows
  from coverage where measured_at is not null group by 1, 2""")
def depth_weeks(spark: SparkSession, d: str) -> DataFrame:
    """The stream's windows, over the table at rest."""
    from seqloom.streaming.incremental import depth_windows

    rows = depth_windows(read(spark, d, "coverage").where("measured_at is not null"))
    return rows.select("sample_name", F.date_format("w.start", "yyyy-MM-dd").alias("week"), F.round("mean_depth", 11).alias("mean_depth"), "n_rows")
