"""Cutting lineage in loops: a table written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and driver and executors are one process, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="dexlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
            where = hadoop.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended
            return


def folder(spark: SparkSession) -> str:
    """A fresh folder in the shared one, removed when the process ends."""
    path = f"{shared_dir(spark)}/level-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_sweep)
    _WRITTEN.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it again."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
