"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it, and its complement (a word), for Java regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Make checkpoints and Python workers usable on any session.

    The checkpoint folder is the one in ``spark.checkpoint.dir``; a local one
    is set only where that is unset and all runs in one process (tests); on a
    cluster that is an error. Workers get this package's
    parent folder on their path.
    """
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidefold-checkpoint-"))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; lower() would change other letters too."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text (string) and _rest, a struct of all columns but text, so that none can clash with an operator's own."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_rest"))


def unpacked(columns: list[str], **changed: Column) -> list[Column]:
    """The columns of packed rows as they were, but for those changed."""
    return [changed.get(c, F.col("text") if c == "text" else F.col("_rest").getField(c)).alias(c) for c in columns]


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    prepare(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def written(docs: DataFrame) -> DataFrame:
    """docs, written as Parquet to a folder that all share and read again: smaller than a checkpoint of texts."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    docs.write.parquet(folder)
    del docs
    forget(spark)
    return spark.read.parquet(folder)


def settled(frame: DataFrame) -> DataFrame:
    """frame, checkpointed; the shuffles behind it may go."""
    spark = frame.sparkSession
    out = frame.checkpoint()
    del frame
    _forget(spark)
    return out


def _forget(spark: SparkSession) -> None:
    """Hint to the driver's JVM to collect plans that nobody refers to any more.

    Spark deletes the files of a shuffle when the driver's collector finds its
    plan dead, which may be long after a checkpoint has cut the lineage; till
    then every step's shuffles stay on the executors' disks. Only plans that
    nothing can read again are found, so a lost executor's work is still redone.
    """
    spark.sparkContext._jvm.java.lang.System.gc()


def forget(spark: SparkSession) -> None:
    """As ``_forget``, but at once, for shuffles of whole texts: about a second.

    Frames in Python's reference cycles keep their plans, and Spark's scheduler
    keeps the plan of the last job till there is another; so cycles are collected
    and a job of one row is run first. Other threads of the driver let go of
    plans a little later, so the hint is given again after growing pauses.
    """
    gc.collect()
    spark.range(0, 1, 1, 1).collect()
    _forget(spark)
    for pause in (0.1, 0.3, 0.6):
        time.sleep(pause)
        _forget(spark)
