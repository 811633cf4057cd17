"""Mixing sources to target weights by a low-discrepancy schedule.

Slot *j* of the mix belongs to the source whose stretch of the cumulative
weights holds the golden-ratio point ``frac((j + 0.5) * phi)``; a source's r-th
slot takes its r-th block of ``block_tokens`` tokens. A source's blocks are its
documents in shuffled order, shuffled anew for each repetition, cut by their
running token sum; it ends with the document that comes nearest to the target.

Two rules for the mix's size: ``all`` makes it as large as all documents; a source
whose target exceeds ``max_repeats`` times its tokens gives all it may and leaves
its further slots empty, while the others keep their share of the whole.
``shares`` makes it the largest mix in which every source with documents holds
its share, relative to the shares of these sources.

Defined results: sources are compared trimmed and in lower case; documents
without a source, of a source without target, or without tokens are not drawn,
though their tokens count in the mix size; a target without documents draws
nothing; a null or negative share or repeat count is 0; a source named twice
keeps its first target by share. Shares are taken as they are: where they add up
to more than 1, the mix is larger than all documents by as much.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.ranks import running_sum
from seqloom.session import cut

GOLDEN = (math.sqrt(5) - 1) / 2
MAX_SOURCES, SLACK, BUCKET_TOKENS = 10_000, 64, 1 << 26


def source_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def budgets(sized: DataFrame, targets: DataFrame, rule: str = "all") -> DataFrame:
    """Per target: ``source, target_share, max_repeats, own_tokens, capacity, target_tokens, total_tokens``.

    *sized*: ``doc_id, source, n_tokens`` with clean source names; *rule*: ``all`` or ``shares``.
    """
    if rule not in ("all", "shares"):
        raise ValueError(f"no rule {rule!r}")
    own = sized.groupBy("source").agg(F.sum("n_tokens").alias("own"))
    total = own.agg(F.coalesce(F.sum("own"), F.lit(0)).cast("long").alias("total_tokens"))
    zero = F.lit(0)
    wanted = (
        targets.select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", zero), zero).cast("double").alias("target_share"), F.greatest(F.coalesce("max_repeats", zero), zero).cast("long").alias("max_repeats"))
        .where("source is not null")
        .groupBy("source")
        .agg(F.max_by("max_repeats", F.struct("target_share", "max_repeats")).alias("max_repeats"), F.max("target_share").alias("target_share"))
    )
    joined = wanted.join(own, "source", "left").crossJoin(F.broadcast(total))
    tokens = F.coalesce("own", zero).cast("long")
    rows = joined.select(
        "source", "target_share", "max_repeats", tokens.alias("own_tokens"), (tokens * F.col("max_repeats")).alias("capacity"),
        (F.col("target_share") * F.col("total_tokens")).alias("target_tokens"), "total_tokens",
    )
    if rule == "all":
        return rows
    # the source that is short the most sets the size
    size = rows.where("capacity > 0 and target_share > 0").agg(F.coalesce(F.min(F.col("capacity") / F.col("target_share")), F.lit(0.0)).alias("__size"))
    target = F.when(F.col("capacity") > 0, F.col("target_share") * F.col("__size")).otherwise(0.0)
    return rows.crossJoin(F.broadcast(size)).withColumn("target_tokens", target).drop("__size")


def block_size(total_tokens: int) -> int:
    """Tokens of a block: about 200,000 slots, with blocks of 512 to 65,536 tokens, so that shares are met closely in any mix."""
    return min(65_536, max(512, total_tokens // 200_000))


def schedule(budget: DataFrame, block_tokens: int) -> DataFrame:
    """``slot, source, block_no`` of the whole mix."""
    spark = budget.sparkSession
    known = budget.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(known) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources with a target")
    weight = [r["target_tokens"] for r in known]
    if not known or sum(weight) <= 0:
        return spark.createDataFrame([], "slot long, source string, block_no long")
    # some slots more than tokens ask for, as a source's slots may fall short by a few; mix() cuts at the target
    n_slots = math.ceil(sum(weight) / block_tokens) + 2 * len(known)
    sums, at = [], 0.0
    for w in weight:
        at += w / sum(weight)
        sums.append(at)
    point = ((F.col("id") + 0.5) * GOLDEN) % 1.0
    # the index of the source: how many cumulative weights the point has passed
    passed = F.size(F.filter(F.array(*map(F.lit, sums[:-1])), lambda x: x <= F.col("u"))) if len(known) > 1 else F.lit(0)
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("u"))
    slots = slots.select("slot", F.get(F.array(*(F.lit(r["source"]) for r in known)), passed).alias("source"))
    return running_sum(slots, ["source"], F.floor(F.col("slot") / 65536), ["slot"], F.lit(1).cast("long"), "block_no")


def planned(sized: DataFrame, targets: DataFrame, block_tokens: int | None = None, rule: str = "all") -> tuple[DataFrame, DataFrame, int]:
    """Budget, schedule and block size of a mix by *rule*."""
    budget = cut(budgets(sized, targets, rule))
    total = budget.agg(F.max("total_tokens")).first()[0] or 0
    block = block_tokens or block_size(total)
    return budget, cut(schedule(budget, block)), block


def mix(sized: DataFrame, targets: DataFrame, block_tokens: int | None = None, seed: int = 42, plan: tuple[DataFrame, DataFrame, int] | None = None) -> DataFrame:
    """``slot, source, doc_id, use_no, n_tokens, block_no, before``: every use of a document, in the order of slot and ``before``, its source's tokens drawn before it."""
    budget, slots, block_tokens = plan or planned(sized, targets, block_tokens)
    # as many repetitions as the source's slots ask for, at most max_repeats
    asked = slots.groupBy("source").agg(F.count(F.lit(1)).alias("n_slots"))
    need = budget.join(asked, "source").where("own_tokens > 0 and max_repeats > 0").select(
        "source", "own_tokens", "n_slots", "target_tokens", F.least("max_repeats", F.ceil(F.col("n_slots") * block_tokens / F.col("own_tokens"))).alias("times")
    )
    uses = sized.where("n_tokens > 0").join(F.broadcast(need), "source").select(  # at most MAX_SOURCES rows
        "source", "doc_id", "n_tokens", "own_tokens", "n_slots", "target_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("use_no")
    )
    # buckets of about BUCKET_TOKENS of the largest source
    largest = budget.agg(F.max("own_tokens")).first()[0] or 0
    bits = max(8, math.ceil(math.log2(max(1, largest // BUCKET_TOKENS))))
    order = F.xxhash64(F.lit(seed), "use_no", "doc_id")
    uses = uses.withColumn("place", order)
    ran = running_sum(uses, ["source", "use_no"], F.shiftright("place", 64 - bits), ["place", "doc_id"], F.col("n_tokens"), "before")
    ran = ran.withColumn("before", F.col("before") + F.col("use_no") * F.col("own_tokens"))
    # the last document is drawn if that brings the source nearer to its target
    drawn = ran.withColumn("block_no", F.floor(F.col("before") / block_tokens)).where("block_no < n_slots and before + n_tokens / 2 <= target_tokens").select("source", "doc_id", "use_no", "n_tokens", "block_no", "before")
    return drawn.join(slots, ["source", "block_no"]).select("slot", "source", "doc_id", "use_no", "n_tokens", "block_no", "before")


def short_sources(sized: DataFrame, targets: DataFrame, block_tokens: int | None = None) -> DataFrame:
    """Sources that cannot reach their target: the schedule gives them slots that no block is left for, or nearly so, and the exact sum decides.

    A slot is open if its block begins less than SLACK blocks before the source's
    tokens end. A source's slots keep within a few blocks of its target (golden-ratio
    points deviate by about the logarithm of their number), so a short source has an
    open slot. One that the schedule gives no slot, its target being under a few
    blocks, is open if it has under SLACK blocks.
    """
    budget, slots, block = planned(sized, targets, block_tokens)
    # one row per source, at most MAX_SOURCES
    given = slots.join(F.broadcast(budget.select("source", "capacity")), "source")
    asked = given.groupBy("source").agg(F.max((F.col("block_no") + SLACK) * F.lit(block) > F.col("capacity")).alias("open"))
    near = budget.join(asked, "source", "left").where(F.coalesce("open", F.col("capacity") < SLACK * block))
    return near.where(F.col("target_tokens") > F.col("capacity")).select("source")


def shares(mixed: DataFrame, budget: DataFrame) -> DataFrame:
    """Per target: what was asked for and what the mix holds, and how often a document was used at most."""
    uses = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("tokens"))
    actual = uses.groupBy("source").agg(F.sum("tokens").alias("mix_tokens"), F.max("uses").alias("most_uses"))
    rows = budget.join(actual, "source", "left").na.fill(0, ["mix_tokens", "most_uses"])
    total = W.partitionBy(F.lit(1))  # one row per target, at most MAX_SOURCES
    return rows.select(
        "source", "target_share", "max_repeats", "own_tokens", F.round("target_tokens").cast("long").alias("target_tokens"), "mix_tokens", "most_uses",
        F.try_divide(F.col("mix_tokens").cast("double"), F.col("total_tokens").cast("double")).alias("share_of_total"),
        F.try_divide(F.col("mix_tokens").cast("double"), F.sum("mix_tokens").over(total).cast("double")).alias("share_of_mix"),
    )
