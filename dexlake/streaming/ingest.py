"""Artifacts that arrive over time: a stream over a folder fills the catalog batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dexlake.sources.artifacts import LONGEST, SCHEMA, contents, wide_records

BINARY = "path string, modificationTime timestamp, length long, content binary"


def artifact_stream(spark: SparkSession, path: str, *, glob: str = "*.apk", files_per_trigger: int = 16, longest: int = LONGEST) -> DataFrame:
    """(aid, path, content) of new files; a trigger takes a bounded number of them.  Files over ``longest`` bytes come without content, as an issue."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return contents(files, longest)


def ingest_stream(artifacts: DataFrame, catalog: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append to a catalog.  A batch that is run again after a failure replaces what it wrote, so artifacts come exactly once; a copy of one that
    an earlier batch or this one has is left out."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates(["aid"])
        if number:
            spark = batch.sparkSession
            known = spark.read.schema(f"{SCHEMA}, batch int").parquet(catalog).where((F.col("kind") == "artifact") & (F.col("batch") < number))
            batch = batch.join(known.select("aid").distinct(), "aid", "left_anti")
        wide_records(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "kind").parquet(catalog)

    writer = artifacts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def search_stream(artifacts: DataFrame, search, sink, checkpoint: str) -> StreamingQuery:
    """Run ``search`` (wide records to hits) on every batch and hand the hits to ``sink`` (DataFrame, batch number)."""
    return artifacts.writeStream.foreachBatch(lambda batch, number: sink(search(wide_records(batch)), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside carry a tag, by which :func:`cancel` ends them; a newer task of a kind can so end the older one."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """End all running jobs with a tag."""
    spark.sparkContext.cancelJobsWithTag(tag)
