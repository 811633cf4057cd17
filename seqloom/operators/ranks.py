"""Running sums and ranks per key that no key can turn into one large task.

The rows of a key are spread over ordered buckets. The sums per key and bucket
give each bucket its opening value, and only the rows of one bucket are ordered
together. Null keys are keys; null values add nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """*df* with the exclusive running sum of *value* per key, in the order of *bucket*, then *order*.

    *df* is read twice, so it should be a kept or cheap one.
    """
    rows = df.withColumn("__bucket", bucket).withColumn("__value", value)
    sums = rows.groupBy(*keys, "__bucket").agg(F.sum("__value").alias("__sum"))
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    opening = sums.select(
        *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__bucket").alias("__b"), F.sum("__sum").over(before).alias("__open")
    )
    inside = W.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__bucket").eqNullSafe(F.col("__b"))]
    total = F.coalesce(F.sum("__value").over(inside), F.lit(0)) + F.coalesce("__open", F.lit(0))
    return rows.join(opening, same).withColumn(out, total).drop("__bucket", "__value", "__b", "__open", *(f"__k{i}" for i in range(len(keys))))
