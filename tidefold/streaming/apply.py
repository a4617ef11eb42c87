"""Structured Streaming: apply change batches once each, and release by resolved watermark."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.operators import cdc
from tidefold.sources import folders


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything there is, batch after batch; the checkpoint folder holds what was read."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def apply_stream(spark: SparkSession, changes: DataFrame, folder: str, schema: str, keys: Sequence[str], order: str) -> DataFrame:
    """Applies a stream of changes to a versioned table: batch n makes version n + 1 from version n, so a repeated batch writes the same version again."""
    if not folders.versions(spark, folder, "v"):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/v0")

    def each(batch: DataFrame, n: int) -> None:
        state = spark.read.schema(schema).parquet(f"{folder}/v{n}")
        cdc.source_wins(state, batch, keys, order).write.mode("overwrite").parquet(f"{folder}/v{n + 1}")

    run_batches(changes, each, f"{folder}/checkpoint")
    return spark.read.schema(schema).parquet(f"{folder}/v{folders.versions(spark, folder, 'v')[-1]}")


def resolved_stream(spark: SparkSession, rows: DataFrame, folder: str, schema: str, parts: Sequence) -> DataFrame:
    """Rows (part, tso, ..) in batches: what every one of the partitions parts has passed is released, the rest waits in a table, all of it until each has been seen. Returns all that was released."""
    if not folders.versions(spark, folder, "wait"):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/wait0")

    def each(batch: DataFrame, n: int) -> None:
        waiting = spark.read.schema(schema).parquet(f"{folder}/wait{n}").unionByName(batch).persist()
        seen, bound = waiting.where(F.col("part").isin(*parts)).groupBy("part").agg(F.max("tso").alias("m")).agg(F.count("m"), F.min("m")).first()
        ready = F.col("tso") < F.lit(bound) if seen == len(set(parts)) else F.lit(False)
        waiting.where(ready).write.mode("overwrite").parquet(f"{folder}/out/{n:06d}")
        # A partition's last row stays, so that its progress is known to the next batch.
        waiting.where(~ready).write.mode("overwrite").parquet(f"{folder}/wait{n + 1}")
        waiting.unpersist()

    run_batches(rows, each, f"{folder}/checkpoint")
    return spark.read.schema(schema).parquet(f"{folder}/out/*")


def counts_by_window(events: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Counts and sums by event time and kind, with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"))
