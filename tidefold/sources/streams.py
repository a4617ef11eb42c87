"""Change streams as Structured Streaming sources: a message log, or a folder that receives pushed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def message_log(spark: SparkSession, servers: str, topic: str, per_batch: int = 100_000, starting: str = "earliest") -> DataFrame:
    """value (text), part and offset of a Kafka topic; the rate limit takes the place of backpressure. Needs Spark's Kafka package."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("maxOffsetsPerTrigger", per_batch).load()
    return raw.select(F.col("value").cast("string").alias("value"), F.col("partition").alias("part"), "offset")


def drop_folder(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """value (a line of JSON text) of files as they arrive."""
    return spark.readStream.option("maxFilesPerTrigger", per_batch).text(folder)
