"""The texts of a folder, kept as a table, so that each file is listed and opened once.

A folder of small files costs one request per file every time it is read. The file stream remembers
which files it has seen, and its sink which of its own it has finished, so a run opens only
files that are new and a run that was broken off adds nothing twice. Batch runs read the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placebook.session import has_files
from placebook.sources.documents import source_name

_SCHEMA = "file string, value string"


def text_stream(spark: SparkSession, path: str, pattern: str = "*.json", files_per_batch: int = 10_000) -> DataFrame:
    """``(file, value)``: each arriving file one row."""
    reader = spark.readStream.format("text").option("wholetext", True)
    reader = reader.option("pathGlobFilter", pattern)
    files = reader.option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select(source_name().alias("file"), "value")


def update_texts(
    spark: SparkSession, path: str, store: str, pattern: str = "*.json", files_per_batch: int = 100_000, files_per_part: int = 1_000
) -> DataFrame:
    """Bring the table below ``store`` up to date with a folder and return it.

    Files are known by their path: one that is written anew under its name is not read again.
    A store belongs to one folder and pattern. ``files_per_part`` texts make a file of the table.
    """
    texts = text_stream(spark, path, pattern, files_per_batch)
    # Spark plans a task per 30 or so small files. Few tasks take them all, and a task's texts are one file of
    # the table, or several.
    few = texts.coalesce(4 * spark.sparkContext.defaultParallelism)
    writer = few.writeStream.format("parquet").option("checkpointLocation", f"{store}/progress")
    writer = writer.option("maxRecordsPerFile", files_per_part)
    writer.trigger(availableNow=True).start(f"{store}/texts").awaitTermination()
    return kept_texts(spark, store)


def kept_texts(spark: SparkSession, store: str) -> DataFrame:
    """``(file, value)`` of all texts kept so far; no file of the folder is opened."""
    if not has_files(spark, f"{store}/texts/_spark_metadata/*"):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(f"{store}/texts")
