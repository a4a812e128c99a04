"""Sheets as a stream of files: each micro-batch runs a batch function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plyframe.operators import reading
from plyframe.sources import files


def events_in_batches(spark: SparkSession, folder: str, schema: str, process: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Run `process` on what arrives in a folder of Parquet files, then stop.

    Batches are numbered, so a sink that keys its output by the number is written
    once per batch even if a batch is run again.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_batch(moves: reading.Runner, out: str, store: str, **options) -> Callable[[DataFrame, int], None]:
    """What reads one micro-batch of image files (path, ...) and writes a row for each
    into `out`/batch=<number>: that folder is replaced as a whole, so a batch that is
    run again is there once.  A file that is no image is a row with its error."""

    def process(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # at most files_per_batch
        if not paths:
            return
        spark = batch.sparkSession
        scans = files.sheet_images(spark, paths).select(F.col("path").alias("sheet"), "image")
        read = reading.read_pages(scans, moves, f"{store}/batch-{number}", **options)
        read.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return process


def pages_in_batches(spark: SparkSession, folder: str, moves: reading.Runner, out: str, store: str, checkpoint: str, pattern: str = "*", files_per_batch: int = 1, **options) -> StreamingQuery:
    """Read the image files of a folder as they come, `files_per_batch` a batch, and
    stop when none is left; a later run goes on with what is new."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    process = page_batch(moves, out, store, **options)
    return stream.select("path").writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
