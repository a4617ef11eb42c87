"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local one where that is unset and all runs in one process, elsewhere an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidefold-")
    return f"{base}/{uuid.uuid4().hex}"


def versions(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the finished tables prefix0, prefix1, .. in a folder, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    done = [n for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n[len(prefix) :]) for n in done)
