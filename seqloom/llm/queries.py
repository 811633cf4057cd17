"""Queries of the problems on texts, vectors and sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import density, mixing, overlaps, packing, similar, splitting
from seqloom.llm.tokens import token_count
from seqloom.operators.tables import long_coverage, row_index
from seqloom.plans.relational import _LONG
from seqloom.session import cut, read

LIMIT, OVERLAP = 2048, 64
DIMS, MIN_LENGTH, NEAREST, NEAR, LINK, LEAST = 136, 1500, 5, 0.0015, 0.05, 5
MAX_SAMPLES = 4096


def _tnf(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "tnf_vec").where(F.col("contig_len") >= MIN_LENGTH)
    return rows.select(F.col("contig_idx").alias("id"), F.col("freqs").alias("vec"))


def _overlaps(spark: SparkSession, d: str, share: float) -> DataFrame:
    joins = read(spark, d, "sketch").select(F.col("contig_idx").alias("set_id"), F.col("hashes").alias("items"), F.lit(1).alias("sign"))
    found = overlaps.estimates(overlaps.apply_changes(None, joins, keep_members=False), share)
    return found.withColumnsRenamed({"a": "contig_a", "b": "contig_b", "common": "common_hashes"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d, 0.5).select("contig_a", "contig_b")


def p3_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Counts, Jaccard index and containment of the pairs that share at least a tenth of the smaller set; ``p3_pairs`` gives the pairs below."""
    return _overlaps(spark, d, 0.1)


def p3_deltas(spark: SparkSession, d: str) -> DataFrame:
    """``p3_overlaps`` from batches: a first load of the wrong members, then joins and leaves until the sets are those of the table."""
    rows = read(spark, d, "sketch").where("contig_idx is not null and hashes is not null")
    third = lambda want: F.filter("hashes", lambda h: F.pmod(h, F.lit(3)).isin(want))
    # hashes of the next contig's set, and of its own by every third value
    strange = rows.select((F.col("contig_idx") + 1).alias("contig_idx"), F.filter("hashes", lambda h: F.pmod(h, F.lit(30)) == 1).alias("hashes"))
    wrong = strange.join(rows.select("contig_idx").distinct(), "contig_idx", "left_semi")
    batch = lambda t, items, sign: t.select(F.col("contig_idx").alias("set_id"), items.alias("items"), F.lit(sign).alias("sign"))
    state = overlaps.apply_changes(None, batch(rows, third([0, 1]), 1).unionByName(batch(wrong, F.col("hashes"), 1)))
    state = overlaps.apply_changes(state, batch(rows, third([2]), 1).unionByName(batch(wrong, F.col("hashes"), -1)))
    # leaving took hashes that both sets have; they join again
    state = overlaps.compacted(overlaps.apply_changes(state, batch(rows, third([1]), 1)))
    return overlaps.estimates(state, 0.1).withColumnsRenamed({"a": "contig_a", "b": "contig_b", "common": "common_hashes"})


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """``p3_overlaps`` of every pair with a common hash; the rows grow with the square of the sets that share one."""
    hashes = cut(read(spark, d, "sketch").select(F.col("contig_idx").alias("s"), F.explode("hashes").alias("h")).where("s is not null and h is not null").distinct())
    sizes = hashes.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    side = lambda x: hashes.select(F.col("s").alias(f"contig_{x}"), "h")
    counted = side("a").join(side("b"), "h").where("contig_a < contig_b").groupBy("contig_a", "contig_b").agg(F.count(F.lit(1)).alias("common_hashes"))
    for x in "ab":
        counted = counted.join(sizes.select(F.col("s").alias(f"contig_{x}"), F.col("n").alias(f"n_{x}")), f"contig_{x}")
    common = F.col("common_hashes")
    jaccard, containment = common / (F.col("n_a") + F.col("n_b") - common), common / F.least("n_a", "n_b")
    return counted.select("contig_a", "contig_b", "common_hashes", "n_a", "n_b", jaccard.alias("jaccard"), containment.alias("containment"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar.mutual_pairs(_tnf(spark, d), NEAR, NEAREST, DIMS)
    return pairs.select(F.col("id_a").alias("contig_a"), F.col("id_b").alias("contig_b"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest contigs by ``freqs`` of every contig whose index is divisible by 20, against all contigs."""
    rows = _tnf(spark, d)
    return similar.neighbours(rows, rows.where("id % 20 = 0").dropDuplicates(["id"]), NEAREST, DIMS)


def _depths(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """``id, contig, vec``: a contig's mean depths by sample, 0 where it was not measured; the id is the place of the name in order."""
    names = [r[0] for r in read(spark, d, "samples").select("sample_name").where("sample_name is not null").distinct().limit(MAX_SAMPLES + 1).collect()]
    if len(names) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples")
    # sample names may hold dots, so columns go by number
    number = F.create_map(*(x for i, n in enumerate(sorted(names)) for x in (F.lit(n), F.lit(i))))
    long = long_coverage(read(spark, d, "coverage")).select("contig", F.try_element_at(number, F.col("sample_name")).alias("s"), "mean")
    wide = long.groupBy("contig").pivot("s", list(range(len(names)))).agg(F.first("mean"))
    vec = F.array(*(F.coalesce(F.col(f"`{i}`"), F.lit(0.0)) for i in range(len(names))))
    return row_index(wide.select("contig", vec.alias("vec")), ["contig"], "id"), len(names)


def p4_depths(spark: SparkSession, d: str) -> DataFrame:
    """The five contigs of the most similar mean depths for every contig whose place in the order of names is divisible by 20, against all."""
    rows, dims = _depths(spark, d)
    rows = cut(rows)
    found = similar.neighbours(rows, rows.where("id % 20 = 0"), NEAREST, dims)
    name, other = rows.select("id", "contig"), rows.select(F.col("id").alias("neighbour"), F.col("contig").alias("neighbour_contig"))
    return found.join(name, "id").join(other, "neighbour").select("contig", "neighbour_contig", "distance", "rank")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return density.chained(_tnf(spark, d), LINK, LEAST, DIMS).withColumnRenamed("id", "contig_idx")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, source, n_tokens`` of all documents, counted once."""
    docs = read(spark, d, "documents")
    return cut(docs.select("doc_id", mixing.source_name(F.col("source")).alias("source"), token_count(F.col("text")).alias("n_tokens")))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or part of one above 2,048 tokens, with its container."""
    docs = read(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"))
    return packing.pack(docs, "doc_id", "n_tokens", LIMIT).withColumnRenamed("item_id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p7_pack(spark, d), LIMIT)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(_sized(spark, d), read(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), read(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, targets = _sized(spark, d), read(spark, d, "mix_targets")
    plan = mixing.planned(sized, targets)
    return mixing.shares(mixing.mix(sized, targets, plan=plan), plan[0])


def p8_even_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the largest mix that meets them for all sources with documents."""
    sized, targets = _sized(spark, d), read(spark, d, "mix_targets")
    plan = mixing.planned(sized, targets, rule="shares")
    return mixing.shares(mixing.mix(sized, targets, plan=plan), plan[0])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(read(spark, d, "documents"), LIMIT, OVERLAP).select("doc_id").distinct()


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(read(spark, d, "documents"), LIMIT, OVERLAP)


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return density.cluster(_tnf(spark, d), DIMS, LINK)


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    """Each contig's cluster (by its smallest contig; null for outliers) and how densely it sits in it."""
    rows = cut(_clusters(spark, d))
    keys = rows.where("cluster is not null").groupBy("cluster").agg(F.min("id").alias("cluster_key"))
    return rows.join(keys, "cluster", "left").select(F.col("id").alias("contig_idx"), "cluster_key", "density")


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's size in contigs and base pairs and its five most typical contigs."""
    lengths = read(spark, d, "tnf_vec").groupBy(F.col("contig_idx").alias("id")).agg(F.max("contig_len").alias("length"))
    return density.describe(_clusters(spark, d), lengths)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found, "p3_overlaps": p3_overlaps, "p3_deltas": p3_deltas, "p3_pairs": p3_pairs,
    "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_depths": p4_depths,
    "p6_found": p6_found, "p6_members": p6_members, "p6_clusters": p6_clusters,
    "p7_pack": p7_pack, "p7_report": p7_report,
    "p8_found": p8_found, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_even_shares": p8_even_shares,
    "p9_found": p9_found, "p9_pieces": p9_pieces,
}

_WHOLE = """
v as (
  select contig_idx as id, any_value(freqs) as f from tnf_vec
  where contig_len >= 1500 and len(freqs) = 136 and len(list_filter(freqs, lambda x: x is null or isnan(x))) = 0 group by 1)
"""
_SETS = """
m as (select distinct contig_idx as s, unnest(hashes) as h from sketch),
n as (select s, count(h) as n from m group by 1),
o as (
  select a.s as contig_a, b.s as contig_b, count(*) as common_hashes from m a join m b on a.h = b.h and a.s < b.s group by 1, 2),
p as (select o.*, x.n as n_a, y.n as n_b from o join n x on x.s = contig_a join n y on y.s = contig_b)
"""
# tokens are beyond SQL; those queries are tested against plain versions instead
ORACLE: dict[str, str] = {
    "p3_found": f"with {_SETS} select contig_a, contig_b from p where common_hashes >= 0.5 * least(n_a, n_b)",
    "p3_overlaps": f"""with {_SETS} select contig_a, contig_b, common_hashes, n_a, n_b,
      common_hashes / (n_a + n_b - common_hashes) as jaccard, common_hashes / least(n_a, n_b) as containment
      from p where common_hashes >= 0.1 * least(n_a, n_b)""",
    "p3_deltas": f"""with {_SETS} select contig_a, contig_b, common_hashes, n_a, n_b,
      common_hashes / (n_a + n_b - common_hashes) as jaccard, common_hashes / least(n_a, n_b) as containment
      from p where common_hashes >= 0.1 * least(n_a, n_b)""",
    "p3_pairs": f"""with {_SETS} select contig_a, contig_b, common_hashes, n_a, n_b,
      common_hashes / (n_a + n_b - common_hashes) as jaccard, common_hashes / least(n_a, n_b) as containment from p""",
    "p4_found": f"""with {_WHOLE},
      d as (select a.id as a, b.id as b, list_distance(a.f, b.f) as d from v a join v b on a.id <> b.id),
      r as (select *, row_number() over (partition by a order by d, b) as n from d)
      select x.a as contig_a, x.b as contig_b from r x join r y on x.a = y.b and x.b = y.a
      where x.a < x.b and x.n <= 5 and y.n <= 5 and x.d <= 0.0015""",
    "p4_neighbours": f"""with {_WHOLE},
      d as (select a.id, b.id as neighbour, list_distance(a.f, b.f) as distance from v a join v b on a.id <> b.id where a.id % 20 = 0),
      r as (select *, row_number() over (partition by id order by distance, neighbour) as rank from d)
      select id, neighbour, distance, cast(rank as int) as rank from r where rank <= 5""",
    "p4_depths": f"""with {_LONG}, c as (select contig, row_number() over (order by contig) - 1 as id from (select distinct contig from l)),
      s as (select distinct sample_name from samples where sample_name is not null),
      v as (select c.id, c.contig, list(coalesce(l.mean, 0.0) order by s.sample_name) as f from c cross join s left join l on l.contig = c.contig and l.sample_name = s.sample_name group by 1, 2),
      d as (select a.contig, b.contig as neighbour_contig, a.id, b.id as other, list_distance(a.f, b.f) as distance from v a join v b on a.id <> b.id where a.id % 20 = 0),
      r as (select *, row_number() over (partition by id order by distance, other) as rank from d)
      select contig, neighbour_contig, distance, cast(rank as int) as rank from r where rank <= 5""",
    "p6_found": f"""with recursive {_WHOLE},
      e as (select a.id as a, b.id as b from v a join v b on a.id <> b.id where list_distance(a.f, b.f) <= 0.05),
      walk as (select id, id as root from v union select e.b, w.root from walk w join e on e.a = w.id where w.root < e.b),
      low as (select id, min(root) as root from walk group by 1),
      sized as (select root, count(*) as n from low group by 1)
      select low.id as contig_idx, low.root as cluster_key from low join sized using (root) where n >= 5""",
}
