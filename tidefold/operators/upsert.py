"""Keyed writes over immutable tables: the new state is the old one without the touched keys, and the batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_of_each(batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a key, the last by order."""
    value = F.max_by(F.struct(*batch.columns), F.col(order)).alias("_v")
    return batch.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(value).select("_v.*")


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of batch replace or join those of target; a key may come once in a batch."""
    return target.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch.select(target.columns))


def insert_missing(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only keys that target lacks are taken."""
    return target.unionByName(batch.join(target.select(*keys), list(keys), "left_anti").select(target.columns))


def update_present(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only keys that target has are replaced."""
    return upsert(target, batch.join(target.select(*keys), list(keys), "left_semi"), keys)


def delete(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(batch.select(*keys).distinct(), list(keys), "left_anti")


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


def append_once(log: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Spool append: an id that is there already, or comes earlier in the batch, is ignored."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    fresh = batch.join(log.select(key), key, "left_anti").withColumn("_n", first).where("_n = 1")
    return log.unionByName(fresh.select(log.columns))


def publish(df: DataFrame, folder: str, version: int) -> str:
    """Write a version and return its path; readers switch by the path, so a failed write is never seen."""
    path = f"{folder}/v{version:08d}"
    df.write.mode("overwrite").parquet(path)
    return path
