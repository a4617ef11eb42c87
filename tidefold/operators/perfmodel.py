"""The numeric performance model as Column expressions; all arithmetic is on whole numbers, rounding down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("bigint")


def ewma(ordered: Column, alpha: int) -> Column:
    """Fold of an ordered array: values of 0 or less are skipped, the first one counts whole."""
    step = lambda a, v: F.when(v <= 0, a).when(a <= 0, v).otherwise(_div(a * (100 - alpha) + v * alpha, 100))
    return F.aggregate(ordered, F.lit(0).cast("bigint"), step)


def percentile(samples: Column, pct: int) -> Column:
    """Nearest rank in an array; 0 for none."""
    n = F.size(samples)
    place = F.greatest(F.lit(1), F.least(n, F.ceil(F.lit(pct) * n / 100).cast("int")))
    return F.when(n > 0, F.element_at(F.array_sort(samples), place)).otherwise(0)


def newest(samples: Column, k: int = 64) -> Column:
    """The last k positive values of an ordered array."""
    positive = F.filter(samples, lambda v: v > 0)
    return F.slice(positive, F.greatest(F.lit(1), F.size(positive) - k + 1), k)


def recommended_rows(rate: Column, seconds: int, least: int, most: int) -> Column:
    return F.when((rate <= 0) | F.lit(seconds <= 0), 0).otherwise(F.least(F.greatest(rate * seconds, F.lit(least)), F.lit(most)))


def bounded_rows(recommended: Column, baseline: Column, low: float, high: float) -> Column:
    """A recommendation kept within factors of a baseline; either alone if the other is missing."""
    a = F.greatest(F.lit(1), F.floor(baseline * low + 0.5))
    b = F.greatest(a, F.floor(baseline * high + 0.5))
    return F.when(recommended <= 0, baseline).when(baseline <= 0, recommended).otherwise(F.greatest(a, F.least(b, recommended))).cast("bigint")


def pieces(rows: Column, each: Column, most: int) -> Column:
    whole = F.ceil(rows / F.when(each > 0, each))
    return F.when((rows <= 0) | (each <= 0), 1).otherwise(F.least(F.greatest(F.lit(1), whole), F.lit(most))).cast("bigint")


def health(rate: Column, table_rate: Column, p99: Column, streak: Column, samples: Column, slow: int = 90_000) -> Column:
    bad = ((table_rate > 0) & (rate * 100 < table_rate * 55)) | (p99 >= slow)
    return F.when(samples < 3, "HEALTHY").when(bad & (streak >= 5), "CIRCUIT_OPEN").when(bad & (streak >= 2), "DEGRADED").otherwise("HEALTHY")


def weight(state: Column) -> Column:
    return F.when(state == "DEGRADED", 50).when(state == "HALF_OPEN", 10).when(state == "CIRCUIT_OPEN", 0).otherwise(100)


def health_rank(state: Column) -> Column:
    return F.when(state == "DEGRADED", 1).when(state == "HALF_OPEN", 2).when(state == "CIRCUIT_OPEN", 3).otherwise(0)


def tail_eta(base: Column, target_ms: int, p_ms: Column, pct: int) -> Column:
    """Seconds left, stretched by a share of how far a percentile is over the target."""
    excess = _div((p_ms - target_ms) * 100, target_ms)
    return F.when(base <= 0, 0).when(p_ms <= target_ms, base).otherwise(_div(base * (100 + _div(excess * pct, 100)), 100))


def backpressure(read_ms: Column, write_ms: Column, warn: int = 3000, critical: int = 8000) -> Column:
    worst = F.greatest(read_ms, write_ms)
    return F.when(worst >= critical, "CRITICAL").when(worst >= warn, "WARN").otherwise("NORMAL")


def capped_batch(level: Column, batch: Column) -> Column:
    """Most rows of the next batch, 0 for no limit."""
    b = F.when(batch > 0, batch).otherwise(500)
    return F.when(level == "CRITICAL", F.greatest(F.lit(50), _div(b, 2))).when(level == "WARN", F.greatest(F.lit(100), _div(b * 3, 4))).otherwise(0).cast("bigint")


def next_batch(batch: Column, latency: Column, target: int = 1200, least: int = 50, most: int = 5000) -> Column:
    """A quarter more while well under the target latency, half beyond twice of it."""
    up, down = _div(batch * 5, 4), _div(batch, 2)
    return F.greatest(F.lit(least), F.least(F.lit(most), F.when(latency > 2 * target, down).when(latency < target, up).otherwise(batch))).cast("bigint")


def worker_score(cpu: Column, memory: Column, jobs: Column, network: Column) -> Column:
    """Load from shares in per cent, by the fixed weights 0.45, 0.25, 0.20 and 0.10."""
    return cpu * 0.45 + memory * 0.25 + jobs * 0.20 + network * 0.10
