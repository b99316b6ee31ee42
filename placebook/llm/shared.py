"""Tables, the folder that executors share, and files in it."""

from __future__ import annotations

import posixpath
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.session import has_files

#: Where a session without ``spark.checkpoint.dir`` keeps its tables; for one machine only.
LOCAL_FOLDER = "file:///tmp/checkpoints/placebook-llm"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder that no run has used before, below ``spark.checkpoint.dir``.

    Only a local master may run without that setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = LOCAL_FOLDER
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str) -> DataFrame:
    """The same rows, written as a table and read again: later steps no longer need the input."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_if_there(spark: SparkSession, sf_dir: str, table: str, schema: str) -> DataFrame:
    """A table, or an empty one of ``schema`` where there is none."""
    if has_files(spark, f"{sf_dir}/{table}.parquet"):
        return read(spark, sf_dir, table)
    return spark.createDataFrame([], schema)


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it; a plain path is a local one."""
    if "://" in folder or folder.startswith("file:"):
        where = folder if "://" in folder else "file://" + folder.removeprefix("file:")
        return fs.FileSystem.from_uri(where)
    return fs.LocalFileSystem(), folder


def write_file(folder: str, name: str, parts: list) -> str:
    """Write a file under another name first, so that a task tried twice leaves one whole file."""
    system, top = file_system(folder)
    system.create_dir(top, recursive=True)
    path = posixpath.join(top, name)
    trial = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(trial) as out:
        for part in parts:
            out.write(part)
    system.move(trial, path)
    return path


def mapped(folder: str, name: str) -> pa.Buffer:
    """A file's bytes: memory-mapped where the folder is mounted, else read through its file system."""
    system, top = file_system(folder)
    path = posixpath.join(top, name)
    if isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(path) as file:
            return file.read_buffer()
    with system.open_input_file(path) as file:
        return file.read_buffer()


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in any letter case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def matched(docs: DataFrame, verdicts: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs``, with all their columns, that are ("left_semi") or are not ("left_anti") in
    ``verdicts`` (doc_id, text_key), by id and text; null ids equal null ids."""
    told_id, told_key = free_name(docs, "told_id"), free_name(docs, "told_key")
    told = verdicts.select(F.col("doc_id").alias(told_id), F.col("text_key").alias(told_key))
    own_id, own_key = docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))
    return docs.join(told, own_id.eqNullSafe(F.col(told_id)) & (own_key == F.col(told_key)), how)
