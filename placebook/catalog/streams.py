"""The incremental path; each query must equal its batch counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.catalog.base import Book, derive, filled_sql, key_sql, plain
from placebook.catalog.files import SUPPLIER_DOCUMENTS, supplier_folder
from placebook.catalog.shapes import BAD_DOCUMENTS, REJECTS_SQL
from placebook.session import count_files, fresh_path
from placebook.sinks.exports import read_csv
from placebook.streaming.replies import (
    each_batch,
    keep_directory,
    keep_progress,
    read_progress,
    reply_stream,
)
from placebook.streaming.store import compact, publish, read_directory, read_rejected

BOOK = Book()

# One bare list per part: two listings, which share keys with those of other parts.
_PART_DOCUMENTS = """
SELECT 'part' || CAST(p_partkey AS STRING) || '.json' AS file, '[{{"company_name": "' || p_name || ' LLC", "city": "' || p_brand || '", "state": "x", ' ||
       '"phone": "' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_size AS STRING) END || '"}}, ' ||
       '{{"company_name": "' || p_name || '", "city": "' || p_brand || '", "state": "X", ' ||
       '"email": ' || CASE WHEN p_partkey % 4 = 0 THEN 'null' ELSE '"e"' END || '}}]' AS value
FROM {part}
"""
_PART_ROWS = """
SELECT p_name || ' LLC' AS company_name, p_brand AS city, 'x' AS state,
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_size AS STRING) END AS phone,
       CAST(NULL AS STRING) AS email FROM {part}
UNION ALL
SELECT p_name, p_brand, 'X', NULL, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'e' END FROM {part}
"""
# A list never names its task, so the file stands in, which is always there.
_BEST_SQL = f"""
WITH rows AS ({plain(_PART_ROWS)}),
keyed AS (SELECT {key_sql('company_name', 'city', 'state')} AS listing_key,
  {filled_sql(['company_name', 'city', 'state', 'phone', 'email'])} + 1 AS filled FROM rows)
SELECT listing_key, CAST(max(filled) AS BIGINT) AS filled, CAST(count(*) AS BIGINT) AS sightings
FROM keyed GROUP BY listing_key
"""


def _kept(spark: SparkSession, sf_dir: str) -> str:
    """Feed the documents, kept as a table of texts, through the stream in several batches."""
    texts = derive(spark, sf_dir, _PART_DOCUMENTS)
    folder = fresh_path(spark, "arriving")
    texts.repartition(6).write.parquet(folder)
    reader = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 2)
    store = fresh_path(spark, "store")
    keep_directory(reader.parquet(folder), store, fresh_path(spark, "progress")).awaitTermination()
    return store


def _facts(directory: DataFrame) -> DataFrame:
    filled = F.col("filled").cast("bigint").alias("filled")
    return directory.select("listing_key", filled, "sightings")


@BOOK.query(_BEST_SQL)
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(read_directory(spark, _kept(spark, sf_dir)))


@BOOK.query(_BEST_SQL)
def stream_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _kept(spark, sf_dir)
    compact(spark, store)
    return _facts(read_directory(spark, store))


@BOOK.query(f"""
WITH rows AS ({plain(_PART_ROWS)}),
kept AS (SELECT upper(state) AS state, max(city) AS city FROM (SELECT *, {key_sql('company_name', 'city', 'state')} AS k FROM rows)
  GROUP BY k, upper(state))
SELECT (SELECT CAST(count(*) AS BIGINT) FROM part) AS input_files,
       (SELECT CAST(count(*) AS BIGINT) FROM rows) AS total_records_found, CAST(count(*) AS BIGINT) AS unique_records,
       (SELECT CAST(count(*) AS BIGINT) FROM rows) - CAST(count(*) AS BIGINT) AS duplicates_removed,
       CAST(count(DISTINCT city) AS BIGINT) AS cities, CAST(count(*) AS BIGINT) AS exported
FROM kept""")
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary, cities and exports of a store that a stream has filled."""
    built = publish(spark, _kept(spark, sf_dir), fresh_path(spark, "published"), ("csv",))
    cities = built.by_state.groupBy().agg(F.max("cities").alias("cities"))
    exported = read_csv(spark, built.output_files[0]).groupBy().agg(F.count("*").alias("exported"))
    return built.summary.join(F.broadcast(cities)).join(F.broadcast(exported))


@BOOK.query(f"""
WITH docs AS ({plain(BAD_DOCUMENTS)}),
numbered AS (SELECT file, value, CAST(replace(replace(file, 'doc', ''), '.json', '') AS BIGINT) % 13 AS kind
             FROM docs)
{REJECTS_SQL}""")
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream rejects is what one run over all documents rejects."""
    texts = derive(spark, sf_dir, BAD_DOCUMENTS)
    folder = fresh_path(spark, "arriving")
    texts.repartition(6).write.parquet(folder)
    stream = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    store = fresh_path(spark, "store")
    keep_directory(stream, store, fresh_path(spark, "progress"), merge_every=2).awaitTermination()
    return read_rejected(spark, store).select("file", F.col("pos").cast("bigint").alias("pos"), "problem")


@BOOK.query(f"""
SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(length(value) + 1) AS BIGINT) AS characters
FROM ({plain(SUPPLIER_DOCUMENTS)})""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = supplier_folder(spark, sf_dir)
    copied = fresh_path(spark, "copied")
    # Every batch costs a commit, so larger tables come in larger batches and not in more of them.
    per_batch = max(40, -(-derive(spark, sf_dir, SUPPLIER_DOCUMENTS).count() // 25))
    stream = reply_stream(spark, folder, "*.txt", files_per_batch=per_batch)

    def copy(batch: DataFrame, batch_id: int) -> None:
        # Spark plans a task per few small files; together they write fewer.
        few = batch.coalesce(4 * spark.sparkContext.defaultParallelism)
        few.write.mode("overwrite").parquet(f"{copied}/batch={batch_id}")

    each_batch(stream, copy, fresh_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(copied).agg(
        F.count_distinct("file").alias("files"), F.sum(F.length("value")).alias("characters")
    )


_RESULTS = """
SELECT CAST(event_id AS STRING) AS task_id, event_type <> 'error' AS success FROM {events}
"""


def _result_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task results as a stream, a few files per batch; larger tables have larger files and batches."""
    folder = fresh_path(spark, "results")
    results = derive(spark, sf_dir, _RESULTS)
    results.write.option("maxRecordsPerFile", max(4000, -(-results.count() // 32))).parquet(folder)
    per_batch = max(2, -(-count_files(spark, f"{folder}/part-*") // 16))
    reader = spark.readStream.schema(results.schema).option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


@BOOK.query("""
SELECT CAST(count(*) AS BIGINT) AS done,
       CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS succeeded,
       CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failed
FROM events""")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "counts")
    stream = _result_stream(spark, sf_dir)
    keep_progress(stream, path, fresh_path(spark, "progress")).awaitTermination()
    return read_progress(spark, path)


@BOOK.query("SELECT CAST(event_id AS STRING) AS task_id FROM events WHERE event_type = 'error'")
def stream_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    noted = fresh_path(spark, "noted")

    def on_complete(batch: DataFrame, batch_id: int) -> None:
        failed = batch.where(~F.col("success")).select("task_id")
        failed.write.mode("overwrite").parquet(f"{noted}/batch={batch_id}")

    stream = _result_stream(spark, sf_dir)
    each_batch(stream, on_complete, fresh_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(noted).select("task_id")
