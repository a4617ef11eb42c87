"""Split planning: ranges, keyset bounds, strategy choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.sources.scan import hash_bucket


def span_for(rows: int, low: int, high: int, target: int) -> int:
    """Width of a chunk when rows spread over [low, high] and a chunk should hold target rows."""
    width = high - low + 1
    rows = rows if rows > 0 else width
    chunks = max(1, -(-rows // max(1, target)))
    return max(1, -(-width // chunks))


def integer_ranges(bounds: DataFrame, span: str = "span") -> DataFrame:
    """bounds: low, high, span. Gap-free inclusive ranges chunk_no, range_start, range_end."""
    starts = F.posexplode(F.sequence("low", "high", span)).alias("chunk_no", "range_start")
    return bounds.where("low <= high").select(starts, "high", span).select(F.col("chunk_no").cast("bigint"), "range_start", F.least(F.col("range_start") + F.col(span) - 1, "high").alias("range_end"))


def row_ranges(df: DataFrame, key: str, target: int) -> DataFrame:
    """Ranges of about target rows each, from the key's range and the row count alone (one aggregate)."""
    width = F.col("high") - F.col("low") + 1
    stats = df.agg(F.min(key).cast("bigint").alias("low"), F.max(key).cast("bigint").alias("high"), F.count("*").alias("rows"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(target)))
    return integer_ranges(stats.where("rows > 0").withColumn("span", F.greatest(F.lit(1), F.ceil(width / chunks)).cast("bigint")))


def keyset_bounds(df: DataFrame, keys: Sequence[str], pieces: int, exact: bool = True) -> DataFrame:
    """First keys of pieces 2 and up: piece and the key columns.

    exact: by NTILE over all rows, which meets in one task and is for tables
    that fit there; otherwise ranges of a distributed range partitioning.
    """
    if exact:
        tiled = df.select(*keys).withColumn("piece", F.ntile(pieces).over(Window.orderBy(*keys)))
    else:
        tiled = df.select(*keys).repartitionByRange(pieces, *keys).withColumn("piece", F.spark_partition_id() + 1)
    return tiled.groupBy("piece").agg(F.min(F.struct(*keys)).alias("k")).where("piece > 1").select("piece", "k.*")


def bounded_keysets(bounds: DataFrame, key: str) -> DataFrame:
    """[none, b1), [b1, b2), .., [bn, none) of one key: chunk_no, lower_key, upper_key."""
    first = bounds.sparkSession.range(1).select(F.lit(None).cast(bounds.schema[key].dataType).alias("lower_key"))
    all_ = first.unionByName(bounds.select(F.col(key).alias("lower_key")))
    order = Window.orderBy(F.col("lower_key").asc_nulls_first())  # one row a chunk
    return all_.select((F.row_number().over(order) - 1).cast("bigint").alias("chunk_no"), "lower_key", F.lead("lower_key").over(order).alias("upper_key"))


def pieces_for(rows: int, parallelism: int, target: int = 100_000) -> int:
    return max(1, min(-(-rows // max(1, target)), 4 * parallelism, 128))


def strategy(asked: str, keys: Sequence[tuple[str, str]], partitions: int = 0) -> str:
    """AUTO is a range for one numeric key, else a keyset; others are checked. keys: (name, kind)."""
    numeric = len(keys) == 1 and keys[0][1] in ("INTEGER", "BIGINT")
    if asked == "AUTO":
        return "PRIMARY_KEY_RANGE" if numeric else "UNIQUE_KEY_RANGE"
    if asked == "PRIMARY_KEY_RANGE" and not numeric:
        raise ValueError("a range needs one numeric key")
    if asked == "PARTITION_RANGE" and not partitions:
        raise ValueError("the table has no partitions")
    if asked not in ("PRIMARY_KEY_RANGE", "UNIQUE_KEY_RANGE", "HASH", "PARTITION_RANGE", "CUSTOM_SQL_RANGE"):
        raise ValueError(f"no such strategy: {asked}")
    return asked


def hash_splits(df: DataFrame, keys: Sequence[str], parallelism: int, buckets: int = 0) -> DataFrame:
    """Rows by hash bucket; twice the parallelism unless told otherwise, 256 at most."""
    n = min(256, buckets or 2 * parallelism)
    return df.withColumn("bucket", hash_bucket(keys, n))


def resplit(start: int, end: int, pieces: int) -> list[tuple[int, int]]:
    """An inclusive range cut evenly; the first pieces take the remainder."""
    n = end - start + 1
    pieces = max(1, min(pieces, n))
    out, at = [], start
    for i in range(pieces):
        size = n // pieces + (i < n % pieces)
        out.append((at, at + size - 1))
        at += size
    return out


def split_remainder(cursor: int, end: int, pieces: int) -> list[tuple[int, int]]:
    """What a chunk has left after its durable cursor, cut evenly."""
    return resplit(cursor + 1, end, pieces) if cursor < end else []
