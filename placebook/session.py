"""Session settings the package relies on, and the shared folder for durable tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Set the one SQL option the JSON functions need.

    JSON objects that repeat a key keep the last value; without the option Spark treats such
    a text as malformed.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


#: Where a local master keeps tables if ``spark.checkpoint.dir`` is unset; for one machine only.
LOCAL_FOLDER = "file:///tmp/checkpoints/placebook"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = LOCAL_FOLDER
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str) -> tuple:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), name


def count_files(spark: SparkSession, pattern: str) -> int:
    """How many files and folders have a path like ``pattern``, on any file system Spark knows."""
    system, name = _file_system(spark, pattern)
    found = system.globStatus(name)
    return 0 if found is None else len(found)


def has_files(spark: SparkSession, pattern: str) -> bool:
    return count_files(spark, pattern) > 0


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the package's own; nothing happens if it is gone already."""
    system, name = _file_system(spark, folder)
    system.delete(name, True)


def replace_folder(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to another place of the same file system, over what is there.

    An empty source, which a write without rows leaves out, gives an empty target.
    """
    system, name = _file_system(spark, target)
    start = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    system.delete(name, True)
    if not system.exists(start):
        system.mkdirs(name)
        return
    system.mkdirs(name.getParent())
    if not system.rename(start, name):
        raise OSError(f"could not move {source} to {target}")
