"""Analytics over task, chunk, position and validation history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_summary(chunks: DataFrame, by: str) -> DataFrame:
    """Per table, and for the whole task (by is null): counts by status and sums over what succeeded."""
    done = F.col("status") == "SUCCESS"
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("bigint")
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return chunks.rollup(by).agg(
        F.count("*").alias("chunks"), count("PENDING"), count("RUNNING"), count("SUCCESS"), count("FAILED"),
        total("row_count").alias("row_count"), total("bytes").alias("bytes"),
        F.sum("read_ms").cast("bigint").alias("read_ms"), F.count_if(F.col("read_ms") > 0).alias("samples"),
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first by order (which must settle ties)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def keep_newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each key, or of all rows where there is no key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= k).drop("_n") if keys else df.orderBy(*order).limit(k)


def first_and_last(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Count, and the value at the least and the greatest order of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(value, order).alias(f"first_{value}"), F.max_by(value, order).alias(f"last_{value}"))


def status_counts(eligible: DataFrame, attempts: DataFrame, keys: Sequence[str], by: str, order: Sequence[Column]) -> DataFrame:
    """Eligible chunks by the status of their newest attempt; those without any are missing."""
    joined = eligible.join(latest(attempts, keys, order).select(*keys, "status"), list(keys), "left")
    count = lambda c: F.count_if(c)
    return joined.groupBy(by).agg(
        F.count("*").alias("eligible"), count(F.col("status") == "SUCCESS").alias("success"), count(F.col("status") == "MISMATCH").alias("mismatch"),
        count(F.col("status") == "ERROR").alias("error"), count(F.col("status").isNull()).alias("missing"),
    )


def evidence_digest(rows: DataFrame, by: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """SHA-256 over the rows of each table in order, with counts by status; a digest of digests, so a row is 64 characters."""
    row = F.sha2(F.concat_ws("|", *(F.col(v).cast("string") for v in values)), 256)
    ordered = F.array_sort(F.collect_list(F.struct(*order, row.alias("_d"))))
    return rows.groupBy(by).agg(F.sha2(F.array_join(F.transform(ordered, lambda r: r["_d"]), ""), 256).alias("digest"), F.count("*").alias("n"), F.count_if(F.col("status") == "SUCCESS").alias("success"))


def backlog_growth(samples: DataFrame, keys: Sequence[str], at: str, size: str) -> DataFrame:
    """Growth of each sample over the one before in bytes a second: only where it grew over half a second or more."""
    w = Window.partitionBy(*keys).orderBy(at, size)
    seconds = (F.col(at) - F.lag(at).over(w)) / 1e6
    grown = F.col(size) - F.lag(size).over(w)
    return samples.withColumn("growth", F.when((grown > 0) & (seconds >= 0.5), F.floor(grown / seconds)).otherwise(0).cast("bigint"))


def peer_risk(chunks: DataFrame) -> DataFrame:
    """Per chunk: distinct other topologies of its table and the worst rank among them, by totals per topology rather than a self join of chunks."""
    placed = chunks.groupBy("table_id", "topology").agg(F.max("rank").alias("worst"))
    other = placed.alias("a").join(placed.alias("b"), (F.col("a.table_id") == F.col("b.table_id")) & (F.col("a.topology") != F.col("b.topology")), "left")
    risk = other.groupBy(F.col("a.table_id").alias("table_id"), F.col("a.topology").alias("topology")).agg(F.count("b.topology").alias("peers"), F.coalesce(F.max("b.worst"), F.lit(0)).alias("worst_peer"))
    return chunks.join(risk, ["table_id", "topology"])


def retained_attempts(attempts: DataFrame, keys: Sequence[str], at: str, id_: str, cap: int, oldest: int) -> DataFrame:
    """Attempts that stay: the newest of a key always, others within the cap and not older than a bound."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(id_)))
    return attempts.withColumn("_n", n).where((F.col("_n") == 1) | ((F.col("_n") <= cap) & (F.col(at) >= oldest))).drop("_n")


def claim_order(candidates: DataFrame, running: DataFrame, caps: DataFrame) -> DataFrame:
    """Pending chunks of tasks below their cap, least loaded task first: rank 1 is the next to claim of its task."""
    load = running.groupBy("task_id").agg(F.count("*").alias("load"))
    open_ = candidates.join(caps, "task_id").join(load, "task_id", "left").withColumn("load", F.coalesce("load", F.lit(0))).where("load < cap")
    n = F.row_number().over(Window.partitionBy("task_id").orderBy("load", F.desc("priority"), "chunk_id"))
    return open_.withColumn("claim_rank", n)
