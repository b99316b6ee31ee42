"""Folders of JSON documents and of raw reply texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.functions.once import with_once
from placebook.functions.payload import reply_json, strict_json
from placebook.functions.truth import present_variant
from placebook.session import prepare


def source_name() -> Column:
    """Name of the file a row was read from, as it is on disk."""
    encoded = F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(encoded)


def read_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(file, value)``: every file directly in a folder, each file one row.

    Files without a byte are left out, as Spark's file sources do.
    """
    # wholetext must be an argument here: as an option text() would reset it.
    reader = spark.read.option("pathGlobFilter", pattern)
    return reader.text(path, wholetext=True).select(source_name().alias("file"), "value")


# What Spark's JSON parser takes: characters in one string, and levels of nesting.
LONGEST_STRING, DEEPEST_NESTING = 20_000_000, 1000


def _depth(text: Column) -> Column:
    """Levels of nesting of a text, brackets inside strings left out."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"?', "")
    steps = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda at, c: F.struct(
            (at["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"),
            F.greatest(at["most"], at["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"),
        ),
    )["most"]


# Why a text gives no value, and, of replies, why a value is no payload.
UNREADABLE = ["encoding", "empty", "not json", "too long", "too deep"]
NO_PAYLOAD = "nothing in it"


def why_unread(text: str, nested: Column, could_nest: Column) -> Column:
    """Which of ``UNREADABLE`` holds for a text without a JSON value.

    A text beyond the parser's limits is told from one that is no JSON; the depth of ``nested``
    is counted only where it could be deep enough.
    """
    openers = F.length(text) - F.length(F.translate(text, "[{", ""))
    deep = (F.length(text) > DEEPEST_NESTING) & could_nest & (openers > DEEPEST_NESTING) & (_depth(nested) > DEEPEST_NESTING)
    return (
        F.when(~F.is_valid_utf8(text), "encoding")
        .when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty")
        .when(F.length(text) > LONGEST_STRING, "too long")
        .when(deep, "too deep")
        .otherwise("not json")
    )


def parse_texts(texts: DataFrame) -> DataFrame:
    """``(file, v, problem)``: the JSON value of each text, or why there is none.

    Files whose stem ends in ``_raw`` are skipped.
    """
    prepare(texts.sparkSession)
    named = texts.where(~F.col("file").rlike(r"_raw\.[^.]*$"))
    parsed = with_once(named, v=F.when(F.is_valid_utf8("value"), strict_json("value")))
    starts = F.ltrim("value").substr(1, 1).isin("[", "{")
    problem = F.when(F.col("v").isNull(), why_unread("value", F.col("value"), starts))
    return parsed.select("file", "v", problem.alias("problem"))


def tag_replies(replies: DataFrame, text: str, prefer: str = "array") -> DataFrame:
    """``replies`` with ``payload``, or with the ``problem`` that leaves a reply without one.

    A payload is a value with something in it: an empty list or object, an empty text, zero, false
    and null are none. Every reply is parsed once and none is left out.
    """
    prepare(replies.sparkSession)
    found = with_once(replies, payload=F.when(F.is_valid_utf8(text), reply_json(text, prefer)))
    # What could be nested starts at the first bracket of any kind.
    bracket = F.regexp_instr(F.col(text), F.lit(r"[\[{]"))
    unread = why_unread(text, F.substr(F.col(text), F.greatest(bracket, F.lit(1))), bracket > 0)
    problem = F.when(F.col("payload").isNull(), unread).when(~F.expr(present_variant("payload")), NO_PAYLOAD)
    tagged = with_once(found, problem=problem)
    return tagged.withColumn("payload", F.when(F.col("problem").isNull(), F.col("payload")))


def scan_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Every document of a folder with its value, or with the reason it cannot be read."""
    return parse_texts(read_texts(spark, path, pattern))


def readable(documents: DataFrame) -> DataFrame:
    """``(file, v)`` of the documents that could be read."""
    return documents.where("problem IS NULL").drop("problem")


def quarantined(documents: DataFrame) -> DataFrame:
    """``(file, problem)`` of the documents that could not be read."""
    return documents.where("problem IS NOT NULL").select("file", "problem")


def scan_raw_replies(spark: SparkSession, path: str, pattern: str = "*_raw.txt") -> DataFrame:
    """``(task_id, value)``: the saved reply texts of a folder."""
    return read_texts(spark, path, pattern).select(
        F.regexp_replace("file", r"_raw\.txt$", "").alias("task_id"), "value"
    )
