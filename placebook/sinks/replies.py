"""Tables of raw replies and of what was found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.operators.enrich import keyed
from placebook.sources.documents import tag_replies


#: Bits of one bitmap of Spark's bitmap functions.
_BLOCK = 32_768


def _write(df: DataFrame, path: str) -> None:
    # Writing a run again replaces that run and leaves the others.
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(path)


def save_replies(results: DataFrame, path: str, run_id: str, prefer: str = "array") -> None:
    """Keep every raw text, and of each its payload or the reason that there is none.

    ``results`` are kept task results; see ``save_results``. Failed ones leave nothing. Replies
    are known by ``task_key``, which is unique within a run. ``parsed_replies`` has a row for every
    raw text: either ``v`` or ``problem`` is null. ``results`` are read once: payloads are cut from the
    raw texts that were written.
    """
    spark = results.sparkSession
    stamp = {"run_id": F.lit(run_id), "saved_at": F.current_timestamp()}
    columns = ["saved_at", "run_id"]
    good = keyed(results).where("success").withColumns(stamp)
    raw = good.select("task_key", "task_id", F.col("output").alias("value"), *columns)
    _write(raw, f"{path}/raw_replies")
    kept = spark.read.schema(raw.schema).parquet(f"{path}/raw_replies").where(F.col("run_id") == run_id)
    tagged = tag_replies(kept, "value", prefer)
    _write(tagged.select("task_key", "task_id", F.col("payload").alias("v"), "problem", *columns), f"{path}/parsed_replies")


def _chosen(rows: DataFrame, run_id: str | None, first: list[Column]) -> DataFrame:
    """The replies of one run, or over all runs one of each key: the last saved, after ``first``.

    It is found on narrow columns; runs saved at the same time go by their id. Texts and payloads stay
    where they are: the rows to keep are told by a bit each, by file and place in it, and these bits are
    sent to every task, an eighth of a byte a reply.
    """
    if run_id is not None:
        return rows.where(F.col("run_id") == run_id)
    place = F.col("_metadata.row_index")
    placed = rows.withColumns(
        {"at_file": F.col("_metadata.file_path"), "at_block": F.floor(place / _BLOCK), "at_bit": place % _BLOCK}
    )
    at = ["at_file", "at_block", "at_bit"]
    keys = placed.select("task_key", "saved_at", "run_id", F.struct(*first, "saved_at", "run_id").alias("stamp"), *at)
    last = keys.groupBy("task_key").agg(F.max("stamp").alias("last")).select("task_key", "last.saved_at", "last.run_id")
    chosen = keys.join(last, ["task_key", "saved_at", "run_id"], "left_semi")
    bits = chosen.groupBy(*at[:2]).agg(F.bitmap_construct_agg("at_bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("at_bit") / 8) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, CAST(at_bit % 8 AS INT))")) != 0
    return placed.join(F.broadcast(bits), at[:2]).where(is_set).select(*rows.columns)


def read_raw_replies(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    return _chosen(spark.read.parquet(f"{path}/raw_replies"), run_id, [])


def _file() -> Column:
    return F.concat("task_key", F.lit(".json")).alias("file")


def read_parsed_replies(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Saved payloads as ``(file, v)`` documents, ready to normalise."""
    rows = spark.read.parquet(f"{path}/parsed_replies").where("problem IS NULL")
    return _chosen(rows, run_id, []).select(_file(), "v")


def read_reply_documents(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """``(file, v, problem)`` of all saved replies, those without a payload included.

    Over all runs a reply with a payload goes before a later one without, as it does for
    ``read_parsed_replies``.
    """
    rows = spark.read.parquet(f"{path}/parsed_replies")
    usable = F.col("problem").isNull().alias("usable")
    return _chosen(rows, run_id, [usable]).select(_file(), "v", "problem")


def read_unusable_replies(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """``(task_key, task_id, problem)`` of the replies without a payload; over all runs, of the last
    reply of each key."""
    rows = _chosen(spark.read.parquet(f"{path}/parsed_replies"), run_id, [])
    return rows.where("problem IS NOT NULL").select("task_key", "task_id", "problem")


def replayed(texts: DataFrame, prefer: str = "array") -> DataFrame:
    """``(file, v, problem)`` documents from kept raw texts, ``(task_id, value)``, without asking again."""
    tagged = tag_replies(keyed(texts).select("task_key", "value"), "value", prefer)
    return tagged.select(_file(), F.col("payload").alias("v"), "problem")
