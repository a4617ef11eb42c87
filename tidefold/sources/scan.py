"""Snapshot scans: each is a predicate over a DataFrame, so Catalyst pushes it to the source."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def range_scan(df: DataFrame, key: str, start: int, end: int, after: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows with start <= key <= end, after an exclusive cursor, in key order when limited."""
    out = df.where(F.col(key).between(start, end))
    if after is not None:
        out = out.where(F.col(key) > after)
    return out.orderBy(key).limit(limit) if limit else out


def lexicographic(keys: Sequence[str], values: Sequence, op: str) -> Column:
    """(k1, .., kn) op (v1, .., vn) as an OR of ANDs, which parquet and JDBC can push down, unlike a struct comparison."""
    strict = op[0]
    compare = {">": lambda c, v: c > v, "<": lambda c, v: c < v}[strict]
    terms = []
    for i, (k, v) in enumerate(zip(keys, values, strict=True)):
        same = [F.col(k2) == F.lit(v2) for k2, v2 in zip(keys[:i], values[:i], strict=True)]
        terms.append(reduce(and_, [*same, compare(F.col(k), F.lit(v))]))
    if op.endswith("="):
        terms.append(reduce(and_, [F.col(k) == F.lit(v) for k, v in zip(keys, values, strict=True)]))
    return reduce(or_, terms)


def keyset_scan(df: DataFrame, keys: Sequence[str], cursor: Sequence | None = None, lower: Sequence | None = None, upper: Sequence | None = None, limit: int | None = None) -> DataFrame:
    """Rows of [lower, upper) in key order; a cursor is exclusive and takes the place of lower."""
    out = df
    if cursor is not None:
        out = out.where(lexicographic(keys, cursor, ">"))
    elif lower is not None:
        out = out.where(lexicographic(keys, lower, ">="))
    if upper is not None:
        out = out.where(lexicographic(keys, upper, "<"))
    return out.orderBy(*keys).limit(limit) if limit else out


def hash_bucket(keys: Sequence[str], n: int) -> Column:
    """First 32 bits of the MD5 of the joined keys, modulo n; null keys count as a marker."""
    text = F.concat_ws("#", *(F.coalesce(F.col(k).cast("string"), F.lit("<NULL>")) for k in keys))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def partition_scan(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value)


_REFUSED = re.compile(r";|--|/\*|\*/|\b(select|insert|update|delete|merge|drop|alter|truncate|create|grant|union|exec|into)\b", re.I)


def custom_scan(df: DataFrame, predicate: str) -> DataFrame:
    """Rows that satisfy a user's predicate; statements, comments and subqueries are refused."""
    if not predicate.strip() or _REFUSED.search(re.sub(r"'(?:[^']|'')*'", "''", predicate)):
        raise ValueError("the predicate is empty or not a plain condition")
    return df.where(F.expr(predicate))


def point_lookup(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each batch key with its row of target, if any; a null key is an error."""
    checked = batch
    for k in keys:
        checked = checked.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.lit(f"key {k} is null"))).otherwise(F.col(k)))
    return checked.join(target, list(keys), "left")


def as_of(log: DataFrame, keys: Sequence[str], order: str, position) -> DataFrame:
    """State at a position of a change log with an operation column: each key's last change up to it, unless a DELETE."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return log.where(F.col(order) <= position).withColumn("_n", last).where("_n = 1 AND operation <> 'DELETE'").drop("_n")


def catalog(df: DataFrame, key: str) -> DataFrame:
    """One row a column: name, type, place, nullable; with the key's range and the row count."""
    spark = df.sparkSession
    fields = spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "ordinal int, column_name string, data_type string")
    stats = df.agg(F.min(key).cast("bigint").alias("min_key"), F.max(key).cast("bigint").alias("max_key"), F.count("*").alias("n_rows"))
    return fields.crossJoin(F.broadcast(stats))  # one row
