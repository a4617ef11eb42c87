"""Canonical values, order-free checksums, validation and repair lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions.rules import FALSE_WORDS, TRUE_WORDS, trim

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "decimal")


def canonical(c: Column, kind: str) -> Column:
    """Text under which equal values of a source kind are equal: booleans 1/0, numbers without trailing zeros, JSON with sorted keys, UUIDs in lower case."""
    t = c.cast("string")
    if kind in ("boolean", "bool", "tinyint(1)", "bit(1)"):
        low = F.lower(t)
        words = [[w for w in ws if w not in ("on", "off")] for ws in (TRUE_WORDS, FALSE_WORDS)]
        return F.when(low.isin(*words[0]), "1").when(low.isin(*words[1]), "0").otherwise(t)
    if kind.startswith(_NUMERIC) or kind in ("numeric", "number", "integer"):
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        plain = F.regexp_replace(plain, r"^(-?)0+(?=\d)", "$1")
        return F.when(plain == "-0", "0").otherwise(plain)
    if kind in ("json", "jsonb"):
        return F.coalesce(F.to_json(F.try_parse_json(t)), t)
    if kind == "uuid":
        return F.lower(trim(t))
    return t


def row_digest(values: Sequence[Column]) -> Column:
    """SHA-256 (hexadecimal) of the values, each framed by its length; null is a mark of its own."""
    framed = [F.when(v.isNull(), F.lit("N|")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v, F.lit("|"))) for v in values]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


def checksum_columns(digest: Column) -> list[Column]:
    """Rows and the sum of digests as eight sums of 32-bit limbs: order-free, multiplicity-sensitive, and merged by adding."""
    limbs = [F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")).alias(f"limb{i}") for i in range(8)]
    return [F.count("*").alias("n_rows"), *limbs]


def checksum(df: DataFrame, values: Sequence[Column], by: Sequence[Column] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*checksum_columns(row_digest(values)))


def checksum_value(limbs: Sequence[int]) -> int:
    """The sum modulo 2 ** 256 from its limbs, most significant first."""
    return sum(n << 32 * (7 - i) for i, n in enumerate(limbs)) % (1 << 256)


def compare(source: DataFrame, target: DataFrame, on: Sequence[str]) -> DataFrame:
    """Per key: rows of both sides and SUCCESS, MISMATCH or MISSING."""
    limbs = [f"limb{i}" for i in range(8)]
    s = source.select(*on, F.col("n_rows").alias("source_rows"), *(F.col(x).alias(f"s_{x}") for x in limbs))
    t = target.select(*on, F.col("n_rows").alias("target_rows"), *(F.col(x).alias(f"t_{x}") for x in limbs))
    same = F.col("source_rows") == F.col("target_rows")
    for x in limbs:
        same = same & (F.col(f"s_{x}") == F.col(f"t_{x}"))
    status = F.when(F.col("target_rows").isNull() | F.col("source_rows").isNull(), "MISSING").when(same, "SUCCESS").otherwise("MISMATCH")
    return s.join(t, list(on), "full").select(*on, F.coalesce("source_rows", F.lit(0)).cast("bigint").alias("source_rows"), F.coalesce("target_rows", F.lit(0)).cast("bigint").alias("target_rows"), status.alias("status"))


def row_difference(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows differ: missing in the target, extra there, or changed."""
    values = [c for c in source.columns if c not in keys]
    digest = lambda df, name: df.select(*keys, row_digest([F.col(c).cast("string") for c in values]).alias(name))
    both = digest(source, "_s").join(digest(target, "_t"), list(keys), "full")
    kind = F.when(F.col("_t").isNull(), "MISSING").when(F.col("_s").isNull(), "EXTRA").otherwise("CHANGED")
    return both.where(~F.col("_s").eqNullSafe(F.col("_t"))).select(*keys, kind.alias("difference"))
