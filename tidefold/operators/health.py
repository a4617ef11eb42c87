"""State machines and gates of running tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def health_fold(samples: Column, good_needed: int = 3) -> Column:
    """Health after an ordered array of structs bad (boolean) and probe (boolean: an open circuit's cooldown is over).

    Two bad samples in a row degrade and five open the circuit; an open one
    waits for a probe; a good probe comes back degraded, and good_needed good
    samples in a row make it healthy again.
    """
    state = lambda h, slow, good: F.struct(h.alias("health"), slow.cast("int").alias("slow"), good.cast("int").alias("good"))

    def step(s: Column, x: Column) -> Column:
        bad = x["bad"]
        slow = F.when(bad, s["slow"] + 1).otherwise(F.greatest(F.lit(0), s["slow"] - 1))
        good = F.when(bad, 0).otherwise(s["good"] + 1)
        now = F.when((s["health"] == "CIRCUIT_OPEN") & x["probe"], "HALF_OPEN").otherwise(s["health"])
        half = F.when(bad, state(F.lit("CIRCUIT_OPEN"), F.greatest(F.lit(5), slow), F.lit(0))).otherwise(state(F.lit("DEGRADED"), F.least(F.lit(1), slow), F.lit(1)))
        degraded = F.when(bad & (slow >= 5), state(F.lit("CIRCUIT_OPEN"), slow, good)).when(good >= good_needed, state(F.lit("HEALTHY"), F.lit(0), F.lit(0))).otherwise(state(F.lit("DEGRADED"), slow, good))
        healthy = F.when(bad & (slow >= 5), state(F.lit("CIRCUIT_OPEN"), slow, F.lit(0))).when(bad & (slow >= 2), state(F.lit("DEGRADED"), slow, F.lit(0))).otherwise(state(F.lit("HEALTHY"), slow, F.lit(0)))
        opened = state(F.lit("CIRCUIT_OPEN"), slow, F.lit(0))
        return F.when(now == "CIRCUIT_OPEN", opened).when(now == "HALF_OPEN", half).when(now == "DEGRADED", degraded).otherwise(healthy)

    return F.aggregate(samples, state(F.lit("HEALTHY"), F.lit(0), F.lit(0)), step)["health"]


def progress_eta(total_bytes: Column, done_bytes: Column, bytes_rate: Column, total_rows: Column, done_rows: Column, rows_rate: Column) -> Column:
    """Seconds left by bytes, else by rows, else 0."""
    by_bytes = F.floor((total_bytes - done_bytes) / F.when(bytes_rate > 0, bytes_rate))
    by_rows = F.floor((total_rows - done_rows) / F.when(rows_rate > 0, rows_rate))
    return F.when((bytes_rate > 0) & (total_bytes > done_bytes), by_bytes).when((rows_rate > 0) & (total_rows > done_rows), by_rows).otherwise(0).cast("bigint")


def sla_risk(remaining: Column, eta95: Column, eta99: Column) -> Column:
    left = F.greatest(F.lit(0), remaining)
    return F.when(eta99 > left, "CRITICAL").when(eta95 > left, "WARN").otherwise("NORMAL")


def cutover_gate(tasks: DataFrame, most_lag: int = 5000) -> DataFrame:
    """Whether a task may switch: nothing pending, an empty spool, small lag, all validated, sequences fresh."""
    reasons = [("PENDING", F.col("pending") > 0), ("SPOOL", F.col("spooled") > 0), ("LAG", F.col("lag_ms") > most_lag), ("VALIDATION", ~F.col("validated")), ("SEQUENCES", ~F.col("sequences_fresh"))]
    blocked = F.array_compact(F.array(*(F.when(c, n) for n, c in reasons)))
    return tasks.withColumn("blocked_by", F.array_join(blocked, ",")).withColumn("ready", F.col("blocked_by") == "")


def merge_profiles(current: DataFrame, incoming: DataFrame, keys: Sequence[str], weight: str = "samples") -> DataFrame:
    """Profiles after an import: an incoming row counts only if it has as many samples or more."""
    side = lambda df, rank: df.withColumn("_r", F.lit(rank))
    both = side(current, 0).unionByName(side(incoming, 1))
    value = F.max_by(F.struct(*[c for c in current.columns if c not in keys]), F.struct(weight, "_r")).alias("_v")
    return both.groupBy(*keys).agg(value).select(*keys, "_v.*").select(current.columns)


def topology_hints(chunks: DataFrame, places: Sequence[str], no: str = "chunk_no", partition: str = "partition_name") -> DataFrame:
    """A place for each chunk: the one its partition is named after, else by turns."""
    known = F.array(*(F.lit(p) for p in places))
    turn = F.element_at(known, (F.col(no) % len(places) + 1).cast("int"))
    return chunks.withColumn("place", F.when(F.array_contains(known, F.col(partition)), F.col(partition)).otherwise(turn))


def remap_keys(foreign_keys: DataFrame, mapping: DataFrame) -> DataFrame:
    """Foreign keys (t, c, ref_t, ref_c) renamed through mapping (t, c, new_t, new_c); names without one stay."""
    out = foreign_keys
    for t, c in (("t", "c"), ("ref_t", "ref_c")):
        m = mapping.select(F.col("t").alias("_t"), F.col("c").alias("_c"), "new_t", "new_c")
        out = out.join(m, (F.col(t) == F.col("_t")) & (F.col(c) == F.col("_c")), "left").withColumn(t, F.coalesce("new_t", t)).withColumn(c, F.coalesce("new_c", c)).drop("_t", "_c", "new_t", "new_c")
    return out
