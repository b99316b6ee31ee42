"""JSON inside reply texts and inside raw web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.catalog.base import Book, derive, plain, table
from placebook.functions.once import with_once
from placebook.functions.payload import (
    balanced_json,
    balanced_slice,
    greedy_json,
    plan_json,
    reply_json,
    strict_json,
    widest_slice,
)
from placebook.functions.truth import present_variant

BOOK = Book()

# One reply per event: its JSON in every kind of wrapping, with a whole document as prose. The
# documents take turns, so each of them is used.
REPLIES = """
SELECT CAST(event_id AS BIGINT) AS event_id,
       CASE event_id % 12
            WHEN 0 THEN props
            WHEN 1 THEN ' [' || props || ', ' || props || '] '
            WHEN 2 THEN prose || '{{"task_id": "t", "businesses": [' || props || ']}}'
            WHEN 3 THEN prose || ' [note] ' || props
            WHEN 4 THEN prose || '[' || props || '] see [2]'
            WHEN 5 THEN prose || '[' || props
            WHEN 6 THEN ''
            WHEN 7 THEN props || prose || props
            WHEN 8 THEN 'null'
            WHEN 9 THEN prose || '["]", ' || props || ']' || prose
            WHEN 10 THEN '] ' || prose || props || ' ['
            ELSE prose || '{{"a": ' || props || '}} then {{"c": 3}}' END AS reply
FROM (SELECT event_id, props, coalesce(text, 'I will search.') AS prose
      FROM (SELECT event_id, props, event_id % (SELECT count(*) FROM {documents}) AS turn FROM {events}) e
      LEFT JOIN {documents} ON turn = doc_id)
"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, REPLIES)


def _facts(rows: DataFrame, payload: Column) -> DataFrame:
    """What a payload holds, in columns that compare well."""
    found = with_once(rows, v=payload)
    v = F.col("v")
    paths = ["$.k", "$.a.k", "$[0].k", "$[1].k", "$.businesses[0].k"]
    return found.select(
        "event_id",
        v.isNotNull().alias("found"),
        F.array_size(F.try_variant_get(v, "$", "array<variant>")).cast("bigint").alias("items"),
        F.coalesce(*[F.try_variant_get(v, path, "bigint") for path in paths]).alias("k"),
    )


def _facts_sql(payload: str) -> str:
    """The same facts about ``payload``, SQL for the JSON text or null."""
    paths = ["$.k", "$.a.k", "$[0].k", "$[1].k", "$.businesses[0].k"]
    ks = ", ".join(f"TRY_CAST(json_extract_string(p, '{path}') AS BIGINT)" for path in paths)
    return f"""
WITH r AS ({plain(REPLIES)}), found AS (SELECT event_id, {payload} AS p FROM r)
SELECT event_id, p IS NOT NULL AS found,
       CASE WHEN json_type(p) = 'ARRAY' THEN CAST(json_array_length(p) AS BIGINT) END AS items,
       coalesce({ks}) AS k
FROM found
"""


def valid_sql(text: str) -> str:
    return f"CASE WHEN json_valid({text}) THEN {text} END"


def widest_sql(text: str, opening: str, closing: str) -> str:
    first = f"strpos({text}, '{opening}')"
    last = f"(length({text}) - strpos(reverse({text}), '{closing}') + 1)"
    return (
        f"CASE WHEN {first} > 0 AND strpos({text}, '{closing}') > 0 AND {last} > {first} "
        f"THEN substr({text}, {first}, {last} - {first} + 1) END"
    )


def balanced_sql(text: str, opening: str, closing: str) -> str:
    rest = f"substr({text}, strpos({text}, '{opening}'))"
    pieces = f"string_split({rest}, '{closing}')"
    head = f"array_to_string(list_slice({pieces}, 1, i), '{closing}')"
    end = (
        f"list_min(list_filter(range(1, len({pieces})), lambda i: "
        f"length({head}) - length(replace({head}, '{opening}', '')) = i))"
    )
    return (
        f"CASE WHEN strpos({text}, '{opening}') > 0 AND {end} IS NOT NULL "
        f"THEN array_to_string(list_slice({pieces}, 1, {end}), '{closing}') || '{closing}' END"
    )


_LIST, _OBJECT = widest_sql("reply", "[", "]"), widest_sql("reply", "{", "}")
GREEDY_SQL = f"coalesce({valid_sql(_LIST)}, {valid_sql(_OBJECT)})"
REPLY_SQL = f"coalesce({valid_sql('reply')}, {GREEDY_SQL})"
PLAN_SQL = f"coalesce({valid_sql('reply')}, {valid_sql(_LIST)}, '[]')"
_BALANCED = [valid_sql(balanced_sql("reply", *pair)) for pair in ("[]", "{}")]
BALANCED_SQL = (
    f"coalesce(CASE WHEN json_valid(trim(reply)) AND trim(reply) <> 'null' THEN trim(reply) END, "
    f"{', '.join(_BALANCED)})"
)
_OBJECT_FIRST = (
    "strpos(reply, '{') > 0 AND (strpos(reply, '[') = 0 OR strpos(reply, '{') < strpos(reply, '['))"
)
OUTERMOST_SQL = (
    f"CASE WHEN {_OBJECT_FIRST} THEN coalesce({valid_sql(_OBJECT)}, {valid_sql(_LIST)}) "
    f"ELSE coalesce({valid_sql(_LIST)}, {valid_sql(_OBJECT)}) END"
)


@BOOK.query(_facts_sql(valid_sql("reply")))
def payload_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(replies(spark, sf_dir), strict_json("reply"))


@BOOK.query(_facts_sql(GREEDY_SQL))
def payload_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(replies(spark, sf_dir), greedy_json("reply"))


@BOOK.query(_facts_sql(OUTERMOST_SQL))
def payload_outermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(replies(spark, sf_dir), greedy_json("reply", "outermost"))


@BOOK.query(_facts_sql(REPLY_SQL))
def payload_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(replies(spark, sf_dir), reply_json("reply"))


@BOOK.query(_facts_sql(PLAN_SQL))
def payload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(replies(spark, sf_dir), plan_json("reply"))


@BOOK.query(_facts_sql(BALANCED_SQL))
def payload_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(replies(spark, sf_dir), balanced_json("reply"))


@BOOK.query(f"""
WITH r AS ({plain(REPLIES)}), found AS (SELECT event_id, {REPLY_SQL} AS p FROM r)
SELECT event_id, json_type(p) AS kind FROM found
WHERE p IS NOT NULL AND p NOT IN ('null', '[]', '{{}}', 'false', '0', '""')
""")
def payload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_once(replies(spark, sf_dir), v=reply_json("reply"))
    is_list = F.try_variant_get("v", "$", "array<variant>").isNotNull()
    return rows.where(present_variant("v")).select(
        "event_id", F.when(is_list, "ARRAY").otherwise("OBJECT").alias("kind")
    )


_SPANS = {
    "list_span": ("widest", "[", "]"),
    "object_span": ("widest", "{", "}"),
    "first_list": ("balanced", "[", "]"),
    "first_object": ("balanced", "{", "}"),
}
_SPAN_SQL = ", ".join(
    f"CAST(length({(widest_sql if how == 'widest' else balanced_sql)('html', *pair)}) AS BIGINT) AS {name}"
    for name, (how, *pair) in _SPANS.items()
)


@BOOK.query(f"SELECT page_id, {_SPAN_SQL} FROM pages")
def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed spans in whole web pages."""
    cuts = {"widest": widest_slice, "balanced": balanced_slice}
    spans = [
        F.length(cuts[how]("html", *pair)).cast("bigint").alias(name)
        for name, (how, *pair) in _SPANS.items()
    ]
    return table(spark, sf_dir, "pages").select("page_id", *spans)
