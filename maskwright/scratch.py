"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; it goes when the driver ends.

    Only where that setting is absent and all runs on this machine (tests in local mode) a temporary
    folder stands in.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = shared or _local.setdefault("dir", tempfile.mkdtemp(prefix="maskwright-"))
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; a session that has ended already is not an error."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM is gone at exit
        return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete the scratch table behind what ``materialise`` returned, once nothing will read it again."""
    discard(df.sparkSession, df._scratch)
