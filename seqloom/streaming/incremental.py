"""Streams of late and repeated deliveries merged into kept tables, one batch at a time.

Each batch is merged by key, so a batch that runs twice changes nothing (the
coverage) or is told apart by its number (the signed counts).
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.orphans import apply_deltas
from seqloom.operators.tables import latest


class VersionedTable:
    """A table kept as numbered folders; readers see the last complete one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self, path: str):  # noqa: ANN202
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs(self.path)
        if not fs.exists(where):
            return []
        names = [PurePosixPath(s.getPath().toString()) for s in fs.listStatus(where)]
        done = [n for n in names if n.name.startswith("v=") and fs.exists(self._fs(f"{self.path}/{n.name}/_SUCCESS")[1])]
        return sorted(int(n.name[2:]) for n in done)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The last version, or the last below *before*."""
        known = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v={known[-1]:012d}") if known else None

    def write(self, df: DataFrame, version: int, keep: int = 2) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version:012d}")
        for v in self.versions()[:-keep]:
            fs, where = self._fs(f"{self.path}/v={v:012d}")
            fs.delete(where, True)


def merge_coverage_stream(stream: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Keeps ``contig, sample_name, mean, var, received_at, cov_id``: of each contig and sample the last received row, whatever the order of arrival."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select("contig", "sample_name", "mean", "var", "received_at", "cov_id")
        old = table.read(number)
        table.write(latest(rows if old is None else old.unionByName(rows), ["contig", "sample_name"], ["received_at", "cov_id"]), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def orphan_count_stream(stream: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Keeps the signed counts ``key, refs, alive`` of a stream of deltas; a batch builds on the version before its own number."""

    def merge(batch: DataFrame, number: int) -> None:
        table.write(apply_deltas(table.read(number), batch), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def depth_windows(stream: DataFrame, late: str = "30 days", width: str = "7 days") -> DataFrame:
    """Mean depth per sample and window of ``measured_at``; rows later than *late* behind the newest are left out by the watermark."""
    timed = stream.withColumn("at", F.col("measured_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "sample_name").agg(F.avg("mean_depth").alias("mean_depth"), F.count(F.lit(1)).alias("n_rows"))
