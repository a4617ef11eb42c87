"""Database sources: disjoint predicates become the partitions of one JDBC read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Bucket expression by dialect, with {k} the joined key text or list and {n} the number of buckets. Fixed formats.
BUCKETS = {
    "mysql": "MOD(CRC32({k}), {n})",
    "postgres": "MOD(('x' || SUBSTR(MD5({k}), 1, 8))::BIT(32)::BIGINT, {n})",
    "oracle": "ORA_HASH({k}, {m})",
    "sqlserver": "(CHECKSUM({k}) & 2147483647) % {n}",
}
_MARKS = {"mysql": "`{}`", "postgres": '"{}"', "oracle": '"{}"', "sqlserver": "[{}]"}


def quoted(dialect: str, name: str) -> str:
    mark = _MARKS[dialect]
    if mark[-1] in name:
        raise ValueError(f"bad name: {name}")
    return mark.format(name)


def range_predicates(key: str, ranges: Sequence[tuple[int, int]]) -> list[str]:
    return [f"{key} >= {int(a)} AND {key} <= {int(b)}" for a, b in ranges]


def bucket_predicates(dialect: str, keys: Sequence[str], n: int) -> list[str]:
    parts = [f"COALESCE(CAST({quoted(dialect, k)} AS CHAR(200)), '<NULL>')" for k in keys]
    text = parts[0] if len(parts) == 1 else f"CONCAT_WS('#', {', '.join(parts)})" if dialect != "oracle" else " || '#' || ".join(parts)
    bucket = BUCKETS[dialect].format(k=text, n=n, m=n - 1)
    return [f"{bucket} = {i}" for i in range(n)]


def read(spark: SparkSession, url: str, table: str, predicates: Sequence[str], properties: dict[str, str] | None = None) -> DataFrame:
    """One partition for each predicate; projections and further filters are pushed to the database."""
    return spark.read.jdbc(url, table, predicates=list(predicates), properties=properties or {})
