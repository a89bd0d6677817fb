"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one Arrow batch handed to a Python worker may hold; long texts then come in short batches.
ARROW_BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, so that a run of very long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset and they are one process, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="dexlake-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_SCRATCH: dict[str, SparkSession] = {}


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    """At the end of the process, remove what :func:`cut` wrote and :func:`drop` didn't."""
    for path, spark in _SCRATCH.items():
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: the folder is left to its owner
            return


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there: lineage ends, and executors may be lost."""
    spark = df.sparkSession
    path = scratch(spark, label)
    if not _SCRATCH:
        atexit.register(_sweep)
    _SCRATCH[path] = spark
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._cut_path = path
    return written


def drop(*tables: DataFrame | None) -> None:
    """Remove tables that :func:`cut` wrote, once all that reads them has been written itself."""
    for t in tables:
        if (path := getattr(t, "_cut_path", None)) in _SCRATCH:
            delete(_SCRATCH.pop(path), path)


def by_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; it returns columns by name, in the order of ``schema``."""
    bounded_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow string column; null is the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def byte_size(column) -> F.Column:
    """UTF-8 bytes of a text column, 0 for null."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
