"""Queries p1, p2 and p5: parsing with reasons, skewed aggregation, orphan references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import orphans as O
from seqloom.operators import rejects as R
from seqloom.operators import skew as S
from seqloom.session import read

HEAVY = 0.05


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return R.parse_lines(read(spark, d, "coverage_lines"), read(spark, d, "coverage_files"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return R.rejects(_parsed(spark, d)).select("line_id", "reason")


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines as coverage rows per contig and sample."""
    lines, files = read(spark, d, "coverage_lines"), read(spark, d, "coverage_files")
    return R.coverage_rows(R.parse_lines(lines, files), R.parse_lines(lines.where("line_no = 1"), files))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Lines per outcome, ``valid`` among them."""
    return _parsed(spark, d).groupBy(F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n_lines"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return S.heavy_hitters(read(spark, d, "membership"), "label", ["run_id", "contig_idx", "assigned_at"], HEAVY).select("label")


def p2_bins(spark: SparkSession, d: str) -> DataFrame:
    """Contigs and size of every bin; a contig assigned again to the same bin counts once."""
    rows = read(spark, d, "membership").where("label is not null")
    bins = S.salted_aggregate(rows, ["run_id", "label"], {"bin_size": "contig_len"}, ["contig_idx"], distinct=True)
    told = read(spark, d, "bin_metrics").select("run_id", "label", F.col("bin_size").alias("reported_size"))
    joined = bins.join(told, ["run_id", "label"], "left")
    return joined.select("run_id", "label", F.col("n_rows").alias("n_contigs"), "bin_size", "reported_size")


def _refs(spark: SparkSession, d: str) -> DataFrame:
    sides = [("coverage", "cov_id", "measured_at"), ("tnf_vec", "tnf_id", "computed_at")]
    parts = [
        read(spark, d, t).select(F.lit(t).alias("src_table"), F.col(i).alias("row_id"), O.first_token(F.col("contig")).alias("key"), F.col(at).alias("at"))
        for t, i, at in sides
    ]
    return parts[0].unionByName(parts[1])


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return O.existence_deltas(read(spark, d, "contigs"), O.first_token(F.col("contig")), "added_at", "removed_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return O.orphans(_refs(spark, d), _deltas(spark, d))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    return O.orphan_report(p5_found(spark, d))


def p5_current(spark: SparkSession, d: str) -> DataFrame:
    """Names referred to of which nothing exists after all changes, from the signed counts per name."""
    refs = _refs(spark, d).select("key", F.lit(1).alias("refs"), F.lit(0).alias("alive"))
    lives = _deltas(spark, d).select("key", F.lit(0).alias("refs"), "alive")
    return O.current_orphans(O.apply_deltas(O.apply_deltas(None, lives), refs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_coverage": p1_coverage, "p1_report": p1_report,
    "p2_found": p2_found, "p2_bins": p2_bins,
    "p5_found": p5_found, "p5_report": p5_report, "p5_current": p5_current,
}

# a field: quoted, with doubled quotes inside, or without any quote
_FIELD = r'''("([^"]|"")*"|[^"\t]*)'''
_LINES = rf"""
lines as (
  select l.line_id, l.file_id, l.line_no, coalesce(f.n_samples, -2) * 2 + 3 as want,
    regexp_replace(coalesce(l.raw_line, ''), '\r$', '') as s
  from coverage_lines l left join (select file_id, max(n_samples) n_samples from coverage_files group by 1) f using (file_id)),
split as (
  select *, regexp_full_match(s, '{_FIELD}(\t{_FIELD})*') as closed,
    -- tabs inside quotes become a mark: only those before an odd number of quotes
    case when s like '%"%' then regexp_extract_all(chr(9) || s, '\t{_FIELD}') else string_split(s, chr(9)) end as raw
  from lines),
clean as (
  select line_id, file_id, line_no, want, closed, list_transform(raw, lambda x: trim(
    case when starts_with(ltrim(x, chr(9)), '"') then replace(substr(ltrim(x, chr(9)), 2, length(ltrim(x, chr(9))) - 2), '""', '"') else ltrim(x, chr(9)) end, ' ')) as v
  from split),
named as (
  select *, list_transform(v, lambda x: replace(regexp_extract(x, '([^/]*)$', 1), '.bam', '')) as h from clean),
judged as (
  select *, case
    when not closed then 'quoting'
    when len(v) <> want then 'column_count'
    when line_no = 1 then case when
        len(list_filter(range(4, len(v), 2), lambda i: h[i] = '' or h[i + 1] <> h[i] || '-var')) > 0
        or len(list_distinct(list_transform(range(4, len(v), 2), lambda i: h[i]))) < (len(v) - 3) // 2 then 'value' end
    when v[1] = '' or not regexp_full_match(v[2], '[0-9]+') or regexp_full_match(v[2], '0+')
      or len(list_filter(v[3:], lambda x: not regexp_full_match(x, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')
        or coalesce(try_cast(x as double), 'inf'::double) < 0 or isinf(coalesce(try_cast(x as double), 'inf'::double)))) > 0 then 'value' end as reason
  from named)
"""
_EVENTS = r"""
refs as (
  select 'coverage' as src_table, cov_id as row_id, regexp_extract(contig, '(\S+)', 1) as k, measured_at as ts from coverage where contig is not null
  union all select 'tnf_vec', tnf_id, regexp_extract(contig, '(\S+)', 1), computed_at from tnf_vec where contig is not null),
recs as (select regexp_extract(contig, '(\S+)', 1) as k, added_at, removed_at from contigs where contig is not null),
judged as (
  select r.src_table, r.row_id, r.ts,
    count(c.k) filter (c.added_at <= r.ts and (c.removed_at is null or c.removed_at > r.ts)) as alive,
    count(c.k) as known, count(c.k) filter (c.added_at <= r.ts) as begun
  from refs r left join recs c on r.k = c.k group by 1, 2, 3),
found as (
  select src_table, row_id, case when known = 0 then 'missing' when begun = 0 and ts is not null then 'early' else 'removed' end as reason,
    strftime(ts, '%Y-%m') as period
  from judged where alive = 0)
"""
ORACLE: dict[str, str] = {
    "p1_found": f"with {_LINES} select line_id, reason from judged where reason is not null",
    "p1_report": f"with {_LINES} select coalesce(reason, 'valid') as outcome, count(*) as n_lines from judged group by 1",
    "p1_coverage": f"""with {_LINES},
      heads as (select file_id, h from judged where line_no = 1 and reason is null),
      body as (select *, unnest(range(1, (len(v) - 3) // 2 + 1)) as k from judged where line_no <> 1 and reason is null)
      select b.line_id, b.file_id, b.v[1] as contig, case when len(b.v[2]) < 19 then cast(b.v[2] as bigint) end as contig_len, case when len(b.v[2]) >= 19 then b.v[2] end as long_len, cast(b.v[3] as double) as avg_depth,
        cast(k as int) as sample_no, heads.h[2 + 2 * k] as sample_name,
        cast(b.v[2 + 2 * k] as double) as mean_depth, cast(b.v[3 + 2 * k] as double) as var_depth
      from body b left join heads using (file_id)""",
    "p2_found": f"select label from membership where label is not null group by label having count(*) >= {HEAVY} * (select count(*) from membership)",
    "p2_bins": """with m as (select distinct run_id, label, contig_idx, contig_len from membership where label is not null)
      select m.run_id, m.label, count(*) as n_contigs, cast(sum(m.contig_len) as bigint) as bin_size, max(b.bin_size) as reported_size
      from m left join bin_metrics b on m.run_id = b.run_id and m.label = b.label group by 1, 2""",
    "p5_found": f"with {_EVENTS} select src_table, row_id, reason, period from found",
    "p5_report": f"with {_EVENTS} select src_table, period, reason, count(*) as n_refs from found group by 1, 2, 3",
    "p5_current": f"""with {_EVENTS},
      lives as (select k, sum(case when added_at is null or removed_at <= added_at or removed_at is not null then 0 else 1 end) as alive from recs group by 1)
      select r.k as key, count(*) as refs from refs r left join lives on r.k = lives.k group by 1 having coalesce(max(alive), 0) <= 0""",
}
