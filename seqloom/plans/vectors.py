"""Queries of distances, graphs and clusterings of vectors; SQL where a brute-force text is possible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import distances as D
from seqloom.operators import assignments as A
from seqloom.operators import blocks as B
from seqloom.operators import embedding, graphs, hdbscan, sketched
from seqloom.operators import tables as T
from seqloom.plans.recover import coverage_vectors
from seqloom.plans.relational import _EVENTS, _LAST, _LONG, _REGISTER, EVENTS, _events, _long, _members, _register, _whole
from seqloom.session import cut, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIMS, TNF, NEAREST, DIGITS = 64, 136, 5, 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- the same formulas as SQL texts ---


def _poly(a: str, terms: tuple[float, ...]) -> str:
    out = repr(terms[0])
    for t in terms[1:]:
        out = f"({out} * {a} + {t!r})"
    return out


def _cdf(x: str) -> str:
    a = f"abs({x})"
    e = f"exp(-{a} * {a} / 2)"
    far = f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65)))))"
    tail = f"(case when {a} > {D.TAIL_FAR} then 0.0 when {a} < {D.TAIL_NEAR} then {e} * {_poly(a, D.TAIL_TOP)} / {_poly(a, D.TAIL_BOTTOM)} else {e} / {far} / {D.ROOT_TWO_PI} end)"
    return f"(case when {x} > 0 then 1 - {tail} else {tail} end)"


def _area(pairs: str, strict: bool) -> str:
    """CTEs that turn *pairs* (a, b, ma, va, mb, vb) into ``dist`` (a, b, distance)."""
    single = "f1 - f2" if strict else "abs(f1 - f2)"
    keep = "present and ma <> mb" if strict else "present"
    area = "area" if strict else f"greatest(case when ma = mb and same then 0.0 else area end, {D.FLOOR!r})"
    return f"""
p1 as (select a, b, ma + {D.SHIFT!r} as ma, mb + {D.SHIFT!r} as mb, greatest(va + {D.SHIFT!r}, 1.0) as va, greatest(vb + {D.SHIFT!r}, 1.0) as vb from ({pairs})),
p2 as (select *, abs(va - vb) < {D.SAME_VARIANCE!r} as same, (ma > {D.SHIFT!r} or mb > {D.SHIFT!r}) as present,
  sqrt(va * vb * ((ma - mb) * (ma - mb) - 2 * (va - vb) * ln(sqrt(vb / va)))) as root from p1),
p3 as (select *, case when same then (ma + mb) / 2 else (root - ma * vb + mb * va) / (va - vb) end as k1,
  case when same then (ma + mb) / 2 else (root + ma * vb - mb * va) / (vb - va) end as k2,
  case when va > vb then mb else ma end as m1, sqrt(case when va > vb then vb else va end) as s1,
  case when va > vb then ma else mb end as m2, sqrt(case when va > vb then va else vb end) as s2 from p2),
p4 as (select *, (least(k1, k2) - m1) / s1 as z1, (least(k1, k2) - m2) / s2 as z2, (greatest(k1, k2) - m1) / s1 as z3, (greatest(k1, k2) - m2) / s2 as z4 from p3),
p5 as (select *, {_cdf("z1")} as f1, {_cdf("z2")} as f2, {_cdf("z3")} as f3, {_cdf("z4")} as f4 from p4),
p6 as (select *, case when abs(k1 - k2) < {D.SHIFT!r} then {single} else abs(f3 - f1 + f2 - f4) end as area from p5),
p7 as (select a, b, case when {keep} then {area} end as area from p6),
dist as (select a, b, case when count(area) = 0 or count(*) filter (area < 0) > 0 then 1.0
  when count(*) filter (area = 0) > 0 then 0.0 else exp(avg(case when area > 0 then ln(area) end)) end as distance from p7 group by a, b)"""


_RHO = """(case when list_sum(list_transform({x}, lambda u: (u - list_avg({x})) * (u - list_avg({x})))) + list_sum(list_transform({y}, lambda u: (u - list_avg({y})) * (u - list_avg({y})))) = 0 then 0.0
  else 0.5 - list_sum(list_transform(list_zip({x}, {y}), lambda z: (z[1] - list_avg({x})) * (z[2] - list_avg({y}))))
  / (list_sum(list_transform({x}, lambda u: (u - list_avg({x})) * (u - list_avg({x})))) + list_sum(list_transform({y}, lambda u: (u - list_avg({y})) * (u - list_avg({y}))))) end)"""
_EMB = "v as (select vec_id as id, label, embedding::double[] as f from embeddings)"
_TNF = "v as (select contig_idx as id, any_value(freqs) as f from tnf_vec where len(freqs) = 136 and len(list_filter(freqs, lambda x: x is null or isnan(x))) = 0 group by 1)"


def _top(source: str, distance: str, where: str, k: int) -> str:
    return f"""with {source}, d as (select a.id, b.id as neighbour, round({distance}, {DIGITS}) as distance from v a join v b on a.id <> b.id where {where}),
      r as (select *, row_number() over (partition by id order by distance, neighbour) as n from d)
      select id, neighbour, distance, cast(n as int) as rank from r where n <= {k}"""


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return _whole(spark, d).groupBy(F.col("contig_idx").alias("id")).agg(F.first("freqs").alias("vec"))


def _packed(rows: DataFrame, dims: int, size: int = B.BLOCK) -> DataFrame:
    return B.pack(rows, "id", "vec", dims, size)


# --- distances ---


@query(_top(_EMB, "list_distance(a.f, b.f)", "a.id % 20 = 0", NEAREST))
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _embeddings(spark, d)
    return B.search(_packed(rows.where("id % 20 = 0"), DIMS, B.QUERY_BLOCK), _packed(rows, DIMS), B.euclid, NEAREST, DIMS, DIGITS)


@query(_top(_TNF, _RHO.format(x="a.f", y="b.f"), "a.id % 20 = 0", NEAREST))
def tnf_distance_search(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(_profiles(spark, d))
    return B.search(_packed(rows.where("id % 20 = 0"), TNF, B.QUERY_BLOCK), _packed(rows, TNF), B.proportional, NEAREST, TNF, DIGITS)


def _event_depths(spark: SparkSession, d: str) -> DataFrame:
    wide = T.wide_coverage(_events(spark, d), EVENTS)
    zero = F.lit(0.0)
    return cut(wide.select(F.col("contig").alias("id"), F.array(*(F.coalesce(f"{s}_{v}", zero) for s in EVENTS for v in ("mean", "var"))).alias("vec")))


def _depth_search(spark: SparkSession, d: str, kernel: B.Kernel) -> DataFrame:
    rows = _event_depths(spark, d)
    dims = 2 * len(EVENTS)
    return B.search(_packed(rows.where("id % 20 = 0"), dims, B.QUERY_BLOCK), _packed(rows, dims), kernel, NEAREST, dims, DIGITS)


def _depth_sql(strict: bool) -> str:
    pairs = "select x.contig as a, y.contig as b, x.mean as ma, x.var as va, y.mean as mb, y.var as vb from g x join g y on x.sample_name = y.sample_name and x.contig <> y.contig where x.contig % 20 = 0"
    return f"""with {_EVENTS}, g as (select c.contig, s.sample_name, coalesce(mean, 0) as mean, coalesce(var, 0) as var
        from (select distinct contig from e) c cross join (select unnest({list(EVENTS)!r}) as sample_name) s left join e on e.contig = c.contig and e.sample_name = s.sample_name),
      {_area(pairs, strict)}, r as (select a as id, b as neighbour, round(distance, {DIGITS}) as distance, row_number() over (partition by a order by round(distance, {DIGITS}), b) as n from dist)
      select id, neighbour, distance, cast(n as int) as rank from r where n <= {NEAREST}"""


@query(_depth_sql(False))
def depth_distance_search(spark: SparkSession, d: str) -> DataFrame:
    return _depth_search(spark, d, B.coverage)


@query(_depth_sql(True))
def depth_distance_strict(spark: SparkSession, d: str) -> DataFrame:
    """With the sign and the skipped samples of the plain formula."""
    return _depth_search(spark, d, B.coverage_strict)


def _hub_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each bin's contigs, in every run, with its smallest one: as many pairs as contigs."""
    members = _members(spark, d).where("label is not null")
    hubs = members.groupBy("run_id", "label").agg(F.min("contig_idx").alias("hub"))
    return members.join(hubs, ["run_id", "label"]).where("hub <> contig_idx").select("run_id", "hub", "contig_idx")


_BIN_PAIRS = """select q.contig_idx as a, q.hub as b, coalesce(x.mean, 0.0) as ma, case when isnan(coalesce(x.var, 0.0)) then 0.0 else coalesce(x.var, 0.0) end as va,
    y.mean as mb, case when isnan(coalesce(y.var, 0.0)) then 0.0 else coalesce(y.var, 0.0) end as vb
  from q join n y on y.contig_idx = q.hub left join n x on x.contig_idx = q.contig_idx and x.sample_name = y.sample_name"""


def _hub_depths(spark: SparkSession, d: str, pairs: DataFrame, keys: list[str]) -> DataFrame:
    # a contig of several names keeps all their rows
    named = _long(spark, d).join(_register(spark, d).select("contig_idx", "contig"), "contig")
    clean = lambda c: F.when(F.isnan(c), 0.0).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
    own = named.select("contig_idx", "sample_name", "mean", clean("var").alias("var"))
    hub = own.select(F.col("contig_idx").alias("hub"), "sample_name", F.col("mean").alias("mean_b"), F.col("var").alias("var_b"))
    joined = pairs.join(hub, "hub").join(own, ["contig_idx", "sample_name"], "left").na.fill(0.0, ["mean", "var"])
    areas = D.with_overlap_area(joined, "mean", "var", "mean_b", "var_b")
    return areas.groupBy(*keys, "contig_idx", "hub").agg(F.round(D.coverage_distance(F.col("area")), DIGITS).alias("distance"))


_HUBS = """h as (select run_id, label, min(contig_idx) as hub from m where label is not null group by 1, 2),
  e as (select m.run_id, h.hub, m.contig_idx from m join h using (run_id, label) where h.hub <> m.contig_idx), q as (select distinct hub, contig_idx from e)"""


@query(f"""with {_LAST}, {_REGISTER}, {_LONG}, {_HUBS}, n as (select c.contig_idx, l.sample_name, l.mean, l.var from l join c using (contig)),
  {_area(_BIN_PAIRS, False)} select e.run_id, e.contig_idx, e.hub, round(distance, {DIGITS}) as distance from dist join e on dist.a = e.contig_idx and dist.b = e.hub""")
def depth_distance_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each contig against its bin's smallest, over the samples of the latter: joins, one expression and a mean."""
    return _hub_depths(spark, d, _hub_pairs(spark, d), ["run_id"])


def _hub_profiles(spark: SparkSession, d: str, pairs: DataFrame, keys: list[str]) -> DataFrame:
    rows = _profiles(spark, d)
    x = rows.select(F.col("id").alias("contig_idx"), F.col("vec").alias("x"))
    y = rows.select(F.col("id").alias("hub"), F.col("vec").alias("y"))
    joined = pairs.join(x, "contig_idx").join(y, "hub")
    return joined.select(*keys, "contig_idx", "hub", F.round(D.proportionality(F.col("x"), F.col("y")), DIGITS).alias("tnf_distance"), F.round(D.euclidean(F.col("x"), F.col("y")), DIGITS).alias("euclidean"))


@query(f"""with {_LAST}, {_HUBS}, {_TNF} select e.run_id, e.contig_idx, e.hub, round({_RHO.format(x="x.f", y="y.f")}, {DIGITS}) as tnf_distance,
  round(list_distance(x.f, y.f), {DIGITS}) as euclidean from e join v x on x.id = e.contig_idx join v y on y.id = e.hub""")
def tnf_distance_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _hub_profiles(spark, d, _hub_pairs(spark, d), ["run_id"])


_SKETCHES = r"""k as (select contig_idx, regexp_extract(any_value(contig), '([a-z]+[0-9]+)_', 1) as assembly, list_distinct(flatten(list(hashes))) as h from sketch where hashes is not null group by 1),
  hub as (select assembly, min(contig_idx) as hub from k group by 1),
  p as (select k.contig_idx, hub.hub, len(list_intersect(k.h, z.h)) as c, len(k.h) as na, len(z.h) as nb from k join hub using (assembly) join k z on z.contig_idx = hub.hub where hub.hub <> k.contig_idx),
  j as (select *, case when na + nb - c = 0 then 1.0 else c / (na + nb - c) end as jaccard from p)"""


@query(f"""with {_SKETCHES} select contig_idx, hub, c as common, case when nb = 0 then 0.0 else c / nb end as containment, jaccard,
  case when na = 0 and nb = 0 then 1.0 when least(na, nb) = 0 then null else c / least(na, nb) end as min_jaccard,
  round(case when jaccard = 0 then 1.0 else least(greatest(-ln(2 * jaccard / (1 + jaccard)) / 31, 0.0), 1.0) end, 9) as mash_distance,
  coalesce(1 - case when na = 0 and nb = 0 then 1.0 when least(na, nb) = 0 then null else c / least(na, nb) end, 1.0) as sketch_distance from j""")
def sketch_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each sketch against the smallest contig's of its assembly."""
    rows = read(spark, d, "sketch").where("hashes is not null").groupBy("contig_idx").agg(F.first("contig").alias("contig"), F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("h"))
    rows = cut(rows.select("contig_idx", F.regexp_extract("contig", "([a-z]+[0-9]+)_", 1).alias("assembly"), "h"))
    hubs = rows.groupBy("assembly").agg(F.min("contig_idx").alias("hub")).join(rows.select(F.col("contig_idx").alias("hub"), F.col("h").alias("hub_h")), "hub")
    pairs = rows.join(hubs, "assembly").where("hub <> contig_idx")
    counted = pairs.select("contig_idx", "hub", F.size(F.array_intersect("h", "hub_h")).cast("long").alias("common"), F.size("h").alias("na"), F.size("hub_h").alias("nb"))
    m = D.sketch_metrics(F.col("common"), F.col("na"), F.col("nb"))
    return counted.select("contig_idx", "hub", "common", *(F.round(c, 9).alias(n) if n == "mash_distance" else c.alias(n) for n, c in m.items()))


# --- sums over labels ---


@query(f"with {_EMB} select a.label, round(avg(list_distance(a.f, b.f)), {DIGITS}) as mean_distance from v a join v b on a.label = b.label and a.id < b.id group by 1")
def bin_metrics_embedding(spark: SparkSession, d: str) -> DataFrame:
    blocks = B.pack(_embeddings(spark, d), "id", "vec", DIMS, label="label", by_label=True)
    return B.within_means(cut(blocks), B.euclid, DIMS).where("n > 1").select("label", F.round("mean_distance", DIGITS).alias("mean_distance"))


@query(f"""with {_LAST}, {_TNF}, x as (select m.run_id, m.label, v.id, v.f from m join v on v.id = m.contig_idx where label is not null),
  s as (select run_id, label, id, list_transform(f, lambda u: u - list_avg(f)) as c from x),
  z as (select run_id, label, id, c, list_sum(list_transform(c, lambda u: u * u)) as q from s),
  n as (select run_id, label, count(*) as n from z group by 1, 2)
  select n.run_id, n.label, n.n, w.mean_distance from n left join (
    select a.run_id, a.label, round(avg(0.5 - list_dot_product(a.c, b.c) / (a.q + b.q)), {DIGITS}) as mean_distance from z a join z b on a.run_id = b.run_id and a.label = b.label and a.id < b.id group by 1, 2) w using (run_id, label)""")
def bin_metrics_tnf(spark: SparkSession, d: str) -> DataFrame:
    """Mean k-mer distance within every bin of every run; null for a single contig."""
    bins, numbers = _numbered_bins(spark, d)
    rows = cut(bins.join(_profiles(spark, d), "id").repartition("bin", F.pmod(F.xxhash64("id"), F.lit(8))))
    blocks = cut(B.pack(rows, "id", "vec", TNF, label="bin", by_label=True))
    return _of_bins(B.within_means(blocks, B.proportional, TNF), numbers)


def _numbered_bins(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """``id, bin`` with one number for each run's label, and what the numbers stand for."""
    members = _members(spark, d).where("label is not null").select("run_id", "label", F.col("contig_idx").alias("id"))
    numbers = cut(A.offset_labels(members, "run_id", "label"))
    return members.join(numbers, ["run_id", "label"]).select("id", F.col("global_label").alias("bin")), numbers


def _of_bins(means: DataFrame, numbers: DataFrame) -> DataFrame:
    told = means.select(F.col("label").alias("global_label"), "n", F.when(~F.isnan("mean_distance"), F.round("mean_distance", DIGITS)).alias("mean_distance"))
    return told.join(numbers, "global_label").select("run_id", "label", "n", "mean_distance")


_HASHES = "k as (select contig_idx as id, list_distinct(flatten(list(hashes))) as h from sketch where hashes is not null and contig_idx is not null group by 1)"
_SKETCH_DISTANCE = "case when len({0}) = 0 and len({1}) = 0 then 0.0 when least(len({0}), len({1})) = 0 then 1.0 else 1 - len(list_intersect({0}, {1})) / least(len({0}), len({1})) end"


def _sets(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "sketch").where("hashes is not null and contig_idx is not null")
    return rows.groupBy(F.col("contig_idx").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("hashes"))


@query(f"""with {_LAST}, {_HASHES}, x as (select m.run_id, m.label, k.id, k.h from m join k on k.id = m.contig_idx where label is not null),
  n as (select run_id, label, count(*) as n from x group by 1, 2)
  select n.run_id, n.label, n.n, w.mean_distance from n left join (
    select a.run_id, a.label, round(avg({_SKETCH_DISTANCE.format("a.h", "b.h")}), {DIGITS}) as mean_distance from x a join x b on a.run_id = b.run_id and a.label = b.label and a.id < b.id group by 1, 2) w using (run_id, label)""")
def bin_metrics_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Mean sketch distance within every bin of every run; null for a single contig."""
    bins, numbers = _numbered_bins(spark, d)
    rows = bins.join(_sets(spark, d), "id").select("id", F.col("bin").alias("label"), "hashes")
    return _of_bins(sketched.within_means(rows), numbers)


_SPANS = f"""g as (select c.contig, s.sample_name, coalesce(mean, 0) as mean, coalesce(var, 0) as var
        from (select distinct contig from e) c cross join (select unnest({list(EVENTS)!r}) as sample_name) s left join e on e.contig = c.contig and e.sample_name = s.sample_name)"""
_ALL_PAIRS = "select x.contig as a, y.contig as b, x.mean as ma, x.var as va, y.mean as mb, y.var as vb from g x join g y on x.sample_name = y.sample_name and {0}"


@query(f"""with {_EVENTS}, {_SPANS}, {_area(_ALL_PAIRS.format("x.contig % 10 = y.contig % 10 and x.contig < y.contig"), False)}
  select cast(a % 10 as int) as label, round(avg(distance), {DIGITS}) as mean_distance from dist group by 1""")
def bin_metrics_depth(spark: SparkSession, d: str) -> DataFrame:
    """Mean coverage distance within bins: of the events' depths, in ten bins by index; a bin of a single contig has no pair and no row."""
    rows = _event_depths(spark, d).withColumn("label", (F.col("id") % 10).cast("int"))
    blocks = cut(B.pack(rows, "id", "vec", 2 * len(EVENTS), label="label", by_label=True))
    return B.within_means(blocks, B.coverage, 2 * len(EVENTS)).where("n > 1").select("label", F.round("mean_distance", DIGITS).alias("mean_distance"))


@query(f"""with {_EVENTS}, {_SPANS}, {_area(_ALL_PAIRS.format("x.contig % 10 <> y.contig % 10"), False)}
  select cast(a % 10 as int) as label, cast(b % 10 as int) as other_label, round(avg(distance), {DIGITS}) as mean_distance from dist group by 1, 2""")
def linkage_depth(spark: SparkSession, d: str) -> DataFrame:
    """Average linkage of the same bins by coverage distance."""
    rows = _event_depths(spark, d).withColumn("label", (F.col("id") % 10).cast("int"))
    return B.linkage(B.pair_sums(rows, B.coverage, 2 * len(EVENTS))).withColumn("mean_distance", F.round("mean_distance", DIGITS))


_SKETCHED = rf"""{_HASHES}, i as (select id, name from (select contig_idx as id, regexp_extract(contig, '(\S+)', 1) as name from sketch where contig is not null and contig_idx is not null) group by 1, 2),
  u as (select i.id as contig, l.sample_name, l.mean, coalesce(l.var, 0.0) as var from l join i on i.name = l.contig),
  g as (select k.id as contig, s.sample_name, coalesce(u.mean, 0) as mean, coalesce(u.var, 0) as var from k cross join (select distinct sample_name from l) s
    left join u on u.contig = k.id and u.sample_name = s.sample_name where k.id in (select contig from u))"""


@query(rf"""with {_LONG}, {_SKETCHED}, {_area(_ALL_PAIRS.format("x.contig <> y.contig"), False)},
  p as (select a, b, round(distance * ({_SKETCH_DISTANCE.format("x.h", "y.h")}), {DIGITS}) as distance from dist join k x on x.id = a join k y on y.id = b),
  r as (select *, row_number() over (partition by a order by distance, b) as n from p)
  select a as src, b as dst, distance, cast(n as int) as rank from r where n <= {NEAREST}""")
def depth_graph(spark: SparkSession, d: str) -> DataFrame:
    """Each sketched contig's nearest by coverage distance times sketch distance, of all sketched contigs."""
    long = cut(_long(spark, d))
    samples = sorted(r[0] for r in long.select("sample_name").distinct().collect())  # the samples of the manifest
    names = read(spark, d, "sketch").where("contig_idx is not null").select(F.col("contig_idx").alias("id"), T.first_token(F.col("contig")).alias("contig")).distinct()
    rows = names.join(coverage_vectors(long, samples), "contig").join(_sets(spark, d), "id")
    found = sketched.search(rows.select("id", F.col("cov").alias("vec"), "hashes"), B.coverage, NEAREST, 2 * len(samples), DIGITS)
    return found.select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), "distance", "rank")


@query(f"with {_EMB} select a.label, b.label as other_label, round(avg(list_distance(a.f, b.f)), {DIGITS}) as mean_distance from v a join v b on a.label <> b.label group by 1, 2")
def linkage(spark: SparkSession, d: str) -> DataFrame:
    blocks = cut(B.pack(_embeddings(spark, d), "id", "vec", DIMS, label="label"))
    return B.linkage(B.label_sums(blocks, B.euclid, DIMS)).withColumn("mean_distance", F.round("mean_distance", DIGITS))


@query(f"""with {_EMB}, l as (select a.label, b.label as other_label, avg(list_distance(a.f, b.f)) as m from v a join v b on a.label <> b.label group by 1, 2)
  select label as src, other_label as dst, round(m, {DIGITS}) as distance, cast(row_number() over (partition by label order by round(m, {DIGITS}), other_label) as int) as rank from l
  qualify row_number() over (partition by label order by round(m, {DIGITS}), other_label) <= 3""")
def cluster_graph(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest clusters of every cluster by average linkage; one row per pair of labels."""
    pairs = linkage(spark, d).select(F.col("label").alias("src"), F.col("other_label").alias("dst"), F.col("mean_distance").alias("distance"))
    return T.rank_in(pairs, ["src"], ["distance", "dst"], "rank").where("rank <= 3")


_SIL = f"""{_EMB}, m as (select a.id, a.label, b.label as o, avg(list_distance(a.f, b.f)) as d from v a join v b on a.id <> b.id group by 1, 2, 3),
  s as (select id, label, max(d) filter (o = label) as a, min(d) filter (o <> label) as b from m group by 1, 2),
  sil as (select id, label, coalesce((b - a) / greatest(a, b), 0.0) as s from s)"""


@query(f"with {_SIL} select id, label, round(s, {DIGITS}) as silhouette from sil")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    blocks = cut(B.pack(_embeddings(spark, d), "id", "vec", DIMS, label="label"))
    return B.silhouettes(B.label_sums(blocks, B.euclid, DIMS)).withColumn("silhouette", F.round("silhouette", DIGITS))


@query(f"with {_SIL} select round(sum(s) / count(*), {DIGITS}) as score, count(*) as n from sil")
def silhouette_score(spark: SparkSession, d: str) -> DataFrame:
    blocks = cut(B.pack(_embeddings(spark, d), "id", "vec", DIMS, label="label"))
    rows = B.silhouettes(B.label_sums(blocks, B.euclid, DIMS))
    return rows.agg(F.round(F.sum("silhouette") / F.count(F.lit(1)), DIGITS).alias("score"), F.count(F.lit(1)).alias("n"))


# --- graphs ---

_G = f"""{_EMB}, e0 as (select a.id as src, b.id as dst, round(list_distance(a.f, b.f), {DIGITS}) as distance from v a join v b on a.id <> b.id),
  e as (select *, cast(row_number() over (partition by src order by distance, dst) as int) as rank from e0 qualify rank <= 10)"""
_G1 = _G.replace("rank <= 10", "rank <= 1")
_G2 = f"""c as (select id, list_transform(f, lambda u: u - list_avg(f)) as c from v), q as (select id, c, list_sum(list_transform(c, lambda u: u * u)) as q from c),
  o0 as (select a.id as src, b.id as dst, round(0.5 - list_dot_product(a.c, b.c) / (a.q + b.q), {DIGITS}) as distance from q a join q b on a.id <> b.id),
  o as (select *, cast(row_number() over (partition by src order by distance, dst) as int) as rank from o0 qualify rank <= 10)"""


def _graph(spark: SparkSession, d: str, kernel: B.Kernel = B.euclid, k: int = 10) -> DataFrame:
    """The graph of all rows' neighbours: the query set is the whole table, in blocks."""
    rows = _embeddings(spark, d)
    found = B.search(_packed(rows, DIMS, B.QUERY_BLOCK), _packed(rows, DIMS), kernel, k, DIMS, DIGITS)
    return cut(found.select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), "distance", "rank"))


@query(f"with {_G} select src, dst, distance, rank from e where rank <= 2 or exists (select 1 from e r where r.src = e.dst and r.dst = e.src)")
def mutual_knn(spark: SparkSession, d: str) -> DataFrame:
    return graphs.mutual(_graph(spark, d), 2)


@query(f"with {_G}, {_G2} select src, dst, distance, rank from e where rank <= 2 or exists (select 1 from o r where r.src = e.dst and r.dst = e.src)")
def graph_intersect(spark: SparkSession, d: str) -> DataFrame:
    return graphs.intersect(_graph(spark, d), _graph(spark, d, B.proportional), 2)


@query(f"with {_G1} select id as src from v where id not in (select src from e where exists (select 1 from e r where r.src = e.dst and r.dst = e.src))")
def disconnected(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are not the nearest of their nearest."""
    nodes = _embeddings(spark, d).select(F.col("id").alias("src"))
    return graphs.disconnected(nodes, graphs.mutual(_graph(spark, d, k=1), 0))


@query()
def prefilter_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Rows left when those without mutual neighbours are removed, again and again."""
    rows = cut(_embeddings(spark, d))

    def build(nodes: DataFrame, keep_n: int) -> DataFrame:
        part = rows.join(nodes.select(F.col("src").alias("id")), "id", "left_semi")
        found = B.search(_packed(part, DIMS, B.QUERY_BLOCK), _packed(part, DIMS), B.euclid, NEAREST, DIMS, DIGITS)
        return graphs.mutual(found.select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), "distance", "rank"), keep_n)

    nodes, _, gone = graphs.prefilter(rows.select(F.col("id").alias("src")), build, 0, 1)
    return nodes.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))


@query()
def embedding_layout(spark: SparkSession, d: str) -> DataFrame:
    """Two-dimensional places of all rows from their fuzzy neighbour graph."""
    out = embedding.embed(embedding.fuzzy_weights(_graph(spark, d)), A.embedding_dims(4))
    return out.select("id", F.round(F.col("vec")[0], 6).alias("x"), F.round(F.col("vec")[1], 6).alias("y"))


@query()
def hdbscan_grid(spark: SparkSession, d: str) -> DataFrame:
    """Silhouette scores of the ten by ten grid of fits."""
    return hdbscan.grid_scores(_embeddings(spark, d), "id", "vec").withColumn("score", F.round("score", DIGITS))


@query()
def hdbscan_best(spark: SparkSession, d: str) -> DataFrame:
    """The grid's best fit."""
    return A.best_of_grid(hdbscan.grid_scores(_embeddings(spark, d), "id", "vec"))


@query()
def hdbscan_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _embeddings(spark, d).withColumn("one", F.lit(0))
    return hdbscan.cluster_groups(rows, ["one"], "id", "vec", choose=hdbscan.best_labels).select("id", "label")
