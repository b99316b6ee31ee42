"""Folders of documents in, reply tables and exports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.catalog.base import Book, derive, plain
from placebook.catalog.listings import WINNERS_SQL, part_winners
from placebook.catalog.texts import OUTERMOST_SQL, REPLIES, REPLY_SQL, replies, valid_sql
from placebook.fixed_values import CSV_COLUMNS
from placebook.operators.dedupe import dedupe
from placebook.operators.normalise import listings, normalise
from placebook.plans.directory import build_directory, directory_of
from placebook.session import fresh_path
from placebook.sinks.exports import (
    export,
    export_csv,
    export_json,
    export_json_document,
    read_csv,
    read_json,
)
from placebook.sinks.replies import (
    read_parsed_replies,
    read_raw_replies,
    read_unusable_replies,
    replayed,
    save_replies,
)
from placebook.sources.documents import (
    parse_texts,
    read_texts,
    readable,
    scan_documents,
)
from placebook.sources.kept_texts import kept_texts

BOOK = Book()

# One document per supplier: its envelope, and what it is known for.
SUPPLIER_DOCUMENTS = """
SELECT s_suppkey,
       CASE WHEN s_suppkey % 9 = 8 THEN 'cut off: [' ELSE
         '{{"task_id": "s' || CAST(s_suppkey AS STRING) || '", "city": "' || n_name ||
         '", "state": "' || r_name || '", "industry": "supply", "businesses": [' ||
         '{{"company_name": "' || s_name || ' LLC", "phone": null}}, ' ||
         '{{"company_name": "Nation store", "phone": "' || CAST(s_suppkey % 4 AS STRING) || '"}}, ' ||
         '{{"company_name": "Nation store Inc", "email": "' ||
         CASE WHEN s_suppkey % 2 = 0 THEN 'n@store.example' ELSE '' END || '"}}]}}' END AS value
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""


def _write_files(spark: SparkSession, texts: DataFrame, path: str) -> None:
    """Write every text as a file of its own below a folder."""
    spread = texts.select("value").repartition(spark.sparkContext.defaultParallelism)
    # Tasks put their files in place themselves; the driver would move one after the other.
    writer = spread.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.option("maxRecordsPerFile", 1).text(path)


def supplier_folder(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "documents")
    _write_files(spark, derive(spark, sf_dir, SUPPLIER_DOCUMENTS), path)
    return path


@BOOK.query(f"""
SELECT CASE WHEN json_valid(value) THEN 'readable' ELSE 'not json' END AS outcome,
       CAST(count(*) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS files
FROM ({plain(SUPPLIER_DOCUMENTS)}) GROUP BY 1
""")
def document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_documents(spark, supplier_folder(spark, sf_dir), "*.txt")
    outcome = F.coalesce("problem", F.lit("readable")).alias("outcome")
    return scanned.groupBy(outcome).agg(
        F.count("*").alias("documents"), F.count_distinct("file").alias("files")
    )


@BOOK.query(f"""
SELECT json_extract_string(value, '$.task_id') AS task_id,
       CAST(json_array_length(value, '$.businesses') AS BIGINT) AS businesses
FROM ({plain(SUPPLIER_DOCUMENTS)}) WHERE json_valid(value)
""")
def readable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_documents(spark, supplier_folder(spark, sf_dir), "*.txt")
    listed = F.try_variant_get("v", "$.businesses", "array<variant>")
    return readable(scanned).select(
        F.variant_get("v", "$.task_id", "string").alias("task_id"),
        F.array_size(listed).cast("bigint").alias("businesses"),
    )


@BOOK.query(f"""
SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(length(value) + 1) AS BIGINT) AS characters
FROM ({plain(SUPPLIER_DOCUMENTS)})
""")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read_texts(spark, supplier_folder(spark, sf_dir), "*.txt")
    return texts.agg(
        F.count_distinct("file").alias("files"), F.sum(F.length("value")).alias("characters")
    )


_BUILT_SQL = f"""
WITH docs AS (SELECT * FROM ({plain(SUPPLIER_DOCUMENTS)}) WHERE json_valid(value)),
cities AS (SELECT s_suppkey, s_name, n_name, r_name FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE s_suppkey IN (SELECT s_suppkey FROM docs)),
kept AS (SELECT s_name AS name, n_name, r_name FROM cities
  UNION SELECT 'Nation store', n_name, r_name FROM cities)
"""


@BOOK.query(f"""{_BUILT_SQL}
SELECT r_name AS state, CAST(count(DISTINCT n_name) AS BIGINT) AS cities,
       CAST(count(*) AS BIGINT) AS businesses
FROM kept GROUP BY 1
""")
def directory_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = supplier_folder(spark, sf_dir)
    return build_directory(spark, folder, fresh_path(spark, "directory"), "*.txt").by_state


@BOOK.query(f"""{_BUILT_SQL}
SELECT CAST(count(*) AS BIGINT) AS input_files,
       CAST(3 * count(*) AS BIGINT) AS total_records_found,
       CAST((SELECT count(*) FROM kept) AS BIGINT) AS unique_records,
       CAST(3 * count(*) - (SELECT count(*) FROM kept) AS BIGINT) AS duplicates_removed
FROM docs
""")
def directory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = supplier_folder(spark, sf_dir)
    return build_directory(spark, folder, fresh_path(spark, "directory"), "*.txt").summary


@BOOK.query(f"""{_BUILT_SQL}
SELECT CAST(count(*) AS BIGINT) AS input_files,
       CAST(3 * count(*) AS BIGINT) AS total_records_found,
       CAST((SELECT count(*) FROM kept) AS BIGINT) AS unique_records,
       CAST(3 * count(*) - (SELECT count(*) FROM kept) AS BIGINT) AS duplicates_removed,
       (SELECT CAST(count(*) AS BIGINT) FROM ({plain(SUPPLIER_DOCUMENTS)})) AS kept_texts
FROM docs
""")
def directory_of_kept_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files come in two lots, each file is opened by one of two runs, and the directory is whole."""
    documents = derive(spark, sf_dir, SUPPLIER_DOCUMENTS)
    folder, store = fresh_path(spark, "documents"), fresh_path(spark, "texts")
    for lot in (0, 1):
        _write_files(spark, documents.where(F.col("s_suppkey") % 2 == lot), folder)
        built = build_directory(spark, folder, fresh_path(spark, "directory"), "*.txt", texts_store=store, formats=())
    texts = kept_texts(spark, store).agg(F.count("*").alias("kept_texts"))
    return built.summary.join(F.broadcast(texts))


@BOOK.query(f"SELECT {', '.join(f'nullif({c}, {chr(39)*2}) AS {c}' for c in CSV_COLUMNS)} FROM ({WINNERS_SQL})")
def export_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    export_csv(part_winners(spark, sf_dir), path)
    return read_csv(spark, path)


@BOOK.query(f"SELECT {', '.join(CSV_COLUMNS)} FROM ({WINNERS_SQL})")
def export_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "json")
    export_json(part_winners(spark, sf_dir), path)
    return read_json(spark, path)[0].select(*CSV_COLUMNS)


@BOOK.query(f"SELECT CAST(count(*) AS BIGINT) AS total_records FROM ({WINNERS_SQL})")
def export_json_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "json")
    export_json(part_winners(spark, sf_dir), path)
    return read_json(spark, path)[1].select("total_records")


def _line_sql(name: str) -> str:
    comma = "" if name == CSV_COLUMNS[-1] else " || ','"
    return f"""'      "{name}": ' || coalesce('"' || {name} || '"', 'null'){comma}"""


@BOOK.query(f"""
WITH w AS ({WINNERS_SQL}),
lines AS (
  SELECT unnest(['    {{', {', '.join(_line_sql(name) for name in CSV_COLUMNS)},
    CASE WHEN first_seen = (SELECT max(first_seen) FROM w) THEN '    }}' ELSE '    }},' END]) AS line
  FROM w
  UNION ALL SELECT unnest(['{{', '  "total_records": ' || CAST(count(*) AS STRING) || ',',
    '  "businesses": [', '  ]', '}}']) FROM w)
SELECT line, CAST(count(*) AS BIGINT) AS times FROM lines GROUP BY line
""")
def export_json_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "document")
    export_json_document(part_winners(spark, sf_dir), path)
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    lines = lines.where(~F.col("line").startswith('  "generated_at"'))
    return lines.groupBy("line").agg(F.count("*").alias("times"))


# A second run asks again for every third reply and gets another one.
_AGAIN = f"SELECT event_id, '[{{{{\"again\": ' || CAST(event_id AS STRING) || '}}}}]' AS reply FROM ({REPLIES}) WHERE event_id % 3 = 0"


def _saved(spark: SparkSession, sf_dir: str, second: bool = False) -> str:
    path = fresh_path(spark, "replies")
    for run_id, rows in (("run1", replies(spark, sf_dir)), ("run2", derive(spark, sf_dir, _AGAIN))):
        if run_id == "run1" or second:
            results = rows.select(
                F.col("event_id").cast("string").alias("task_id"),
                F.lit(True).alias("success"),
                F.col("reply").alias("output"),
            )
            save_replies(results, path, run_id)
    return path


@BOOK.query(f"""
SELECT CAST(event_id AS STRING) AS task_id, CASE WHEN event_id % 3 = 0
  THEN '[{{"again": ' || CAST(event_id AS STRING) || '}}]' ELSE reply END AS value,
  CASE WHEN event_id % 3 = 0 THEN 'run2' ELSE 'run1' END AS run_id
FROM ({plain(REPLIES)})""")
def replies_of_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_raw_replies(spark, _saved(spark, sf_dir, second=True)).select("task_id", "value", "run_id")


@BOOK.query(f"SELECT CAST(event_id AS STRING) AS task_id, reply AS value FROM ({plain(REPLIES)})")
def raw_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_raw_replies(spark, _saved(spark, sf_dir)).select("task_id", "value")


@BOOK.query(f"""
WITH r AS ({plain(REPLIES)}), found AS (SELECT event_id, {REPLY_SQL} AS p FROM r)
SELECT CAST(event_id AS STRING) || '.json' AS file,
       CASE WHEN json_type(p) = 'ARRAY' THEN CAST(json_array_length(p) AS BIGINT) END AS items
FROM found WHERE p IS NOT NULL AND p <> 'null'
""")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = read_parsed_replies(spark, _saved(spark, sf_dir))
    items = F.array_size(F.try_variant_get("v", "$", "array<variant>")).cast("bigint")
    return parsed.select("file", items.alias("items"))


@BOOK.query(f"""
WITH r AS ({plain(REPLIES)}), found AS (SELECT event_id, reply, {REPLY_SQL} AS p FROM r)
SELECT CAST(event_id AS STRING) AS task_id, CASE WHEN reply = '' THEN 'empty'
       WHEN p IS NULL THEN 'not json' ELSE 'nothing in it' END AS problem
FROM found WHERE p IS NULL OR p IN ('null', '[]', '{{}}', 'false', '0', '""')
""")
def unusable_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply is either in ``parsed_replies`` or here, with the reason."""
    return read_unusable_replies(spark, _saved(spark, sf_dir)).select("task_id", "problem")


@BOOK.query(f"""
WITH r AS ({plain(REPLIES)}), a AS (SELECT event_id, {REPLY_SQL} AS p FROM r),
o AS (SELECT event_id, coalesce({valid_sql('reply')}, {OUTERMOST_SQL}) AS p FROM r),
two_ways AS (SELECT 'array' AS prefer, * FROM a UNION ALL SELECT 'outermost', * FROM o),
found AS (SELECT * FROM two_ways WHERE p IS NOT NULL AND p NOT IN ('null', '[]', '{{}}', 'false', '0', '""'))
SELECT prefer, CAST(count(*) AS BIGINT) AS documents,
       CAST(count(*) FILTER (WHERE json_type(p) = 'ARRAY') AS BIGINT) AS lists,
       CAST(count(*) FILTER (WHERE json_extract(p, '$.businesses') IS NOT NULL) AS BIGINT) AS envelopes
FROM found GROUP BY 1""")
def replayed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept raw texts, read again both ways without asking again."""
    texts = read_raw_replies(spark, _saved(spark, sf_dir))
    listed = F.try_variant_get("v", "$", "array<variant>").isNotNull()
    enveloped = F.try_variant_get("v", "$.businesses", "variant").isNotNull()
    both = [readable(replayed(texts, prefer)).withColumn("prefer", F.lit(prefer)) for prefer in ("array", "outermost")]
    return both[0].unionByName(both[1]).groupBy("prefer").agg(
        F.count("*").alias("documents"),
        F.count_if(listed).alias("lists"),
        F.count_if(enveloped).alias("envelopes"),
    )


# Searchers' replies: prose, an envelope, prose; of some nothing can be read.
_CHATTY = f"""
SELECT CAST(s_suppkey AS STRING) AS task_id, 'I will search. ' || value || ' Done.' AS value
FROM ({SUPPLIER_DOCUMENTS})
"""


@BOOK.query(f"""{_BUILT_SQL},
listed AS (SELECT 'array' AS prefer, name, '' AS city, '' AS state FROM kept
  UNION SELECT 'outermost', name, n_name, r_name FROM kept)
SELECT prefer, (SELECT CAST(count(*) AS BIGINT) FROM docs) AS input_files,
       (SELECT CAST(3 * count(*) AS BIGINT) FROM docs) AS total_records_found,
       CAST(count(*) AS BIGINT) AS unique_records,
       (SELECT CAST(count(*) AS BIGINT) FROM ({plain(SUPPLIER_DOCUMENTS)}) WHERE NOT json_valid(value)) AS rejected
FROM listed GROUP BY prefer""")
def replayed_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = derive(spark, sf_dir, _CHATTY)
    counted = []
    for prefer in ("array", "outermost"):
        built = directory_of(replayed(texts, prefer), fresh_path(spark, "replayed"), formats=())
        unread = built.rejected.agg(F.count_if(F.col("problem") == "not json").alias("rejected"))
        counted.append(built.summary.withColumn("prefer", F.lit(prefer)).join(F.broadcast(unread)))
    names = ["prefer", "input_files", "total_records_found", "unique_records", "rejected"]
    return counted[0].unionByName(counted[1]).select(*names)


# Every document under two names: as a document, and as the raw reply it came from.
_NAMED = f"""
SELECT 's' || CAST(s_suppkey AS STRING) || ending AS file, value
FROM ({SUPPLIER_DOCUMENTS}) CROSS JOIN (SELECT '.txt' AS ending UNION ALL SELECT '_raw.txt') AS e
"""


@BOOK.query(f"""
SELECT 's' || CAST(s_suppkey AS STRING) || '.txt' AS file, json_valid(value) AS readable
FROM ({plain(SUPPLIER_DOCUMENTS)})""")
def raw_suffix_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = parse_texts(derive(spark, sf_dir, _NAMED))
    return scanned.select("file", F.col("problem").isNull().alias("readable"))


# A profile for every order; a customer's profiles are one business.
_PROFILES = """
SELECT 'doc' || CAST(o_orderkey AS STRING) || '.json' AS file,
       '{{"company_name": "' || c_name || '", "location": {{"city": "' || n_name || '", "state": "S"}}, ' ||
       '"business_details": {{"fleet_size": ' || CAST(o_custkey AS STRING) || '}}, "key_contacts": ["' ||
       c_mktsegment || '"], "online_presence": {{"site": null}}}}' AS value
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""


@BOOK.query("""
SELECT c_name AS company_name, n_name AS city, CAST(c_custkey AS BIGINT) AS fleet_size, c_mktsegment AS contact,
       TRUE AS has_presence
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def export_json_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listings(normalise(parse_texts(derive(spark, sf_dir, _PROFILES))))
    path = fresh_path(spark, "extras")
    export_json(dedupe(found, ["file", "pos"]), path)
    return read_json(spark, path)[0].select(
        "company_name",
        "city",
        F.variant_get("business_details", "$.fleet_size", "bigint").alias("fleet_size"),
        F.variant_get("key_contacts", "$[0]", "string").alias("contact"),
        F.col("online_presence").isNotNull().alias("has_presence"),
    )


@BOOK.query(f"""
SELECT unnest(['csv', 'json']) AS format, CAST((SELECT count(*) FROM ({WINNERS_SQL})) AS BIGINT) AS businesses""")
def export_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    winners, path = part_winners(spark, sf_dir), fresh_path(spark, "formats")
    csv, = export(winners, f"{path}/a", ("csv",))
    json, = export(winners, f"{path}/b", ("json",))
    rows = [("csv", read_csv(spark, csv)), ("json", read_json(spark, json)[0])]
    counted = [df.agg(F.count("*").alias("businesses")).withColumn("format", F.lit(name)) for name, df in rows]
    return counted[0].unionByName(counted[1]).select("format", "businesses")
