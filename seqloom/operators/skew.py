"""A few keys holding most records: two-stage salted aggregation.

Keys that hold at least ``heavy_share`` of the rows get a salt; partial results
are made per key and salt and then merged by key, so the largest group that any
task sees is a salt's, whatever the key's share. The salt is a hash of the
columns that tell records apart, which is as even as a random one, gives the
same result when a lost task runs again, and keeps repeats of one record under
one salt, so that distinct counts merge by adding. (Records that agree in all
these columns share a salt, but the map side makes one row of them.)

Defined results: a null key is a key of its own; nulls in a summed column add
nothing (a group of nulls only sums to null); an empty table gives no rows;
repeated rows count as often as they stand unless ``distinct`` says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.session import cut

SALT, COUNT = "__salt", "__count"


def heavy_keys(df: DataFrame, keys: Sequence[str], heavy_share: float) -> DataFrame:
    """Keys with at least that share of the rows: at most ``1 / heavy_share`` of them, so fit for a broadcast."""
    counts = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(COUNT)))  # one row per key
    total = counts.agg(F.sum(COUNT).alias("__total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col(COUNT) >= heavy_share * F.col("__total")).select(*keys)


def salted(df: DataFrame, keys: Sequence[str], identity: Sequence[str], heavy_share: float = 0.001, salts: int = 64) -> DataFrame:
    """*df* with a salt: 0 for light keys, a hash of *identity* for heavy ones."""
    heavy = heavy_keys(df, keys, heavy_share).select(*(F.col(k).alias(f"__{k}") for k in keys), F.lit(True).alias("__heavy"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = df.join(F.broadcast(heavy), same, "left")
    salt = F.when(F.col("__heavy"), F.pmod(F.xxhash64(*identity), F.lit(salts)).cast("int")).otherwise(0)
    return joined.withColumn(SALT, salt).drop(*(f"__{k}" for k in keys), "__heavy")


def salted_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    sums: dict[str, Column | str],
    identity: Sequence[str],
    distinct: bool = False,
    heavy_share: float = 0.001,
    salts: int = 64,
) -> DataFrame:
    """Row count ``n_rows`` and the named sums per key.

    *identity* are the columns that tell records apart. With *distinct*, rows
    that agree in the keys, these and the summed columns count once.
    """
    value = {name: (F.expr(x) if isinstance(x, str) else x) for name, x in sums.items()}
    # the working names keep clear of any column of the caller's table
    slim = df.select(*keys, *(F.col(c).alias(f"__id{i}") for i, c in enumerate(identity)), *(v.alias(f"__v_{n}") for n, v in value.items()))
    ids = [f"__id{i}" for i in range(len(identity))]
    parts = salted(slim, keys, ids, heavy_share, salts)
    if distinct:
        parts = parts.groupBy(*keys, SALT, *ids, *(f"__v_{n}" for n in value)).agg(F.count(F.lit(1)).alias("__times")).drop("__times")
    partial = parts.groupBy(*keys, SALT).agg(F.count(F.lit(1)).alias("__n"), *(F.sum(f"__v_{n}").alias(f"__s_{n}") for n in value))
    return partial.groupBy(*keys).agg(F.sum("__n").alias("n_rows"), *(F.sum(f"__s_{n}").alias(n) for n in value))


def heavy_hitters(df: DataFrame, key: str, identity: Sequence[str], share: float, **how: float) -> DataFrame:
    """Keys other than null that hold at least *share* of all rows (null keys count among all)."""
    # one row per key, read for the total and again for the keys
    counts = cut(salted_aggregate(df, [key], {}, identity, **how))
    total = counts.agg(F.sum("n_rows").alias("__total"))
    kept = counts.where(F.col(key).isNotNull()).crossJoin(F.broadcast(total))
    return kept.where(F.col("n_rows") >= F.lit(share) * F.col("__total")).select(key, "n_rows")
