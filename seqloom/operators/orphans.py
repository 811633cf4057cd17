"""References to records that do not exist, by signed counts.

A key's existence is the running sum of +1 where a record of it begins and -1
where it ends; a reference with a running sum of 0 is an orphan. Adds and
references per key are kept the same way, so late records only add deltas.
Keys with very many rows are split by hour: an hour's opening sum comes from the
signed sums of the hours before, and only the hour's own rows are ordered.

Defined results: a record without a begin, or that ends no later than it
begins, never exists but still makes its key known; a reference with a null key
is no reference; one without a time is ``missing`` if its key is unknown, else
``removed``, with a null period; repeated records only raise the sums; repeated
references are reported as often as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.session import cut


def first_token(name: Column) -> Column:
    """The first whitespace-separated token of a name, null for null."""
    return F.regexp_extract(name, r"(\S+)", 1)


def existence_deltas(records: DataFrame, key: Column, begin: str, end: str) -> DataFrame:
    """``key, at, alive, adds``: the signed changes of each key's existence; ``at`` is null where a record only makes its key known."""
    base = records.select(key.alias("key"), F.col(begin).alias("b"), F.col(end).alias("e")).where("key is not null")
    lives = "b is not null and (e is null or e > b)"
    nothing = F.array(F.struct(F.col("b").alias("at"), F.lit(0).alias("alive"), F.when(F.col("b").isNull(), 0).otherwise(1).alias("adds")))
    born = F.struct(F.col("b").alias("at"), F.lit(1).alias("alive"), F.lit(1).alias("adds"))
    gone = F.struct(F.col("e").alias("at"), F.lit(-1).alias("alive"), F.lit(0).alias("adds"))
    change = F.when(~F.coalesce(F.expr(lives), F.lit(False)), nothing).when(F.col("e").isNull(), F.array(born)).otherwise(F.array(born, gone))
    return base.select("key", F.explode(change).alias("c")).select("key", "c.at", "c.alive", "c.adds")


def orphans(refs: DataFrame, deltas: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """``src_table, row_id, reason, period`` of the references without an existing record.

    *refs*: ``src_table, row_id, key, at``; *deltas* as above.
    """
    changes = deltas.select(
        F.lit(None).cast("string").alias("src_table"), F.lit(None).cast("long").alias("row_id"), "key", "at",
        "alive", "adds", F.lit(1).alias("known"), F.lit(0).alias("is_ref"),
    )
    events = changes.unionByName(
        refs.where("key is not null").select(
            "src_table", "row_id", "key", "at",
            F.lit(0).alias("alive"), F.lit(0).alias("adds"), F.lit(0).alias("known"), F.lit(1).alias("is_ref"),
        )
    )
    # at most rows / hot_rows keys; whether there are any decides if the split by hour is planned at all
    hot = cut(events.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("key", F.lit(True).alias("hot")))
    split = not hot.isEmpty()
    hour = F.when(F.col("hot"), F.date_trunc("hour", "at")) if split else F.lit(None).cast("timestamp")
    events = (events.join(hot, "key", "left") if split else events.withColumn("hot", F.lit(None))).withColumn("hour", hour).drop("hot")
    # changes come before the references of their moment: added_at <= t counts, removed_at = t ends; nulls sort first
    upto = W.partitionBy("key", "hour").orderBy("at", "is_ref").rowsBetween(W.unboundedPreceding, 0)
    run = events.select(
        "*", F.sum("alive").over(upto).alias("alive_now"), F.sum("adds").over(upto).alias("adds_now"),
        F.max("known").over(W.partitionBy("key", "hour")).alias("is_known"),
    )
    found = run.where("is_ref = 1 and (at is null or alive_now <= 0)")
    if split:
        sums = events.where("hour is not null").groupBy("key", "hour").agg(F.sum("alive").alias("a"), F.sum("adds").alias("d"))
        before = W.partitionBy("key").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
        opening = sums.select("key", "hour", F.sum("a").over(before).alias("open_alive"), F.sum("d").over(before).alias("open_adds"))
        known = events.join(hot, "key", "left_semi").groupBy("key").agg(F.max("known").alias("hot_known"))
        found = (
            found.join(opening, ["key", "hour"], "left")
            .join(known, "key", "left")
            .withColumn("alive_now", F.col("alive_now") + F.coalesce("open_alive", F.lit(0)))
            .withColumn("adds_now", F.col("adds_now") + F.coalesce("open_adds", F.lit(0)))
            .withColumn("is_known", F.greatest("is_known", F.coalesce("hot_known", F.lit(0))))
            .where("at is null or alive_now <= 0")
        )
    reason = F.when(F.col("is_known") == 0, "missing").when(F.col("at").isNotNull() & (F.col("adds_now") == 0), "early").otherwise("removed")
    return found.select("src_table", "row_id", reason.alias("reason"), F.date_format("at", "yyyy-MM").alias("period"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references per table, month and reason."""
    return found.groupBy("src_table", "period", "reason").agg(F.count(F.lit(1)).alias("n_refs"))


def apply_deltas(state: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The state ``key, refs, alive`` after signed ``deltas`` of the same columns; keys without any count are dropped."""
    rows = deltas.select("key", "refs", "alive") if state is None else state.select("key", "refs", "alive").unionByName(deltas.select("key", "refs", "alive"))
    return rows.where("key is not null").groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("alive").alias("alive")).where("refs <> 0 or alive <> 0")


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist now."""
    return state.where("refs > 0 and alive <= 0").select("key", "refs")
