"""Compatibility findings and dependency order."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def findings(columns: DataFrame) -> DataFrame:
    """columns: table_name, column_name, universal, has_key, generated. One row a finding: level and code."""
    rules = [
        (F.col("universal") == "UNKNOWN", "WARNING", "UNKNOWN_TYPE"),
        (~F.col("has_key"), "UNSUPPORTED", "NO_STABLE_KEY"),
        (F.col("generated"), "INFO", "GENERATED_COLUMN"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for c, level, code in rules)))
    return columns.select("table_name", "column_name", F.explode(found).alias("f")).select("table_name", "column_name", "f.level", "f.code")


def verdict(found: DataFrame) -> DataFrame:
    """Findings by level, and whether a task can start."""
    return found.agg(F.count_if(F.col("level") == "WARNING").alias("warnings"), F.count_if(F.col("level") == "UNSUPPORTED").alias("unsupported"), F.count_if(F.col("level") == "INFO").alias("notes")).withColumn("can_start", F.col("unsupported") == 0)


def dependency_order(names: Iterable[str], edges: Iterable[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Names so that each follows what it needs (name breaks ties), and those on or behind a cycle. edges: (name, needs)."""
    names = set(names)
    needs, used = defaultdict(set), defaultdict(set)
    for a, b in edges:
        if a in names and b in names and a != b:
            needs[a].add(b)
            used[b].add(a)
        elif a == b:
            needs[a].add(a)
    ready = [n for n in names if not needs[n]]
    heapq.heapify(ready)
    out = []
    while ready:
        n = heapq.heappop(ready)
        out.append(n)
        for m in used[n]:
            needs[m].discard(n)
            if not needs[m]:
                heapq.heappush(ready, m)
    return out, sorted(names - set(out))
