"""Documents of every shape, made into listing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.catalog.base import Book, derive, plain
from placebook.catalog.texts import REPLIES, replies
from placebook.operators.normalise import LISTING_FIELDS, listings, normalise, rejected
from placebook.sources.documents import parse_texts, quarantined, readable

BOOK = Book()

_ELEMENT = """'{{"company_name": "' || c_name || '", "address": "' || o_orderpriority ||
 '", "phone": ' || CASE WHEN o_orderkey % 7 = 0 THEN 'null' WHEN o_orderkey % 7 = 1 THEN '0'
                        WHEN o_orderkey % 7 = 2 THEN CAST(o_orderkey AS STRING)
                        ELSE '"' || CAST(o_custkey AS STRING) || '"' END ||
 ', "email": "' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'a@b.example' END || '"'"""
_ENVELOPE = """'{{"task_id": "task' || CAST(o_orderkey AS STRING) || '", "city": "' || n_name ||
 '", "state": "' || o_orderstatus || '", "industry": "' || c_mktsegment || '", "businesses": '"""



def _documents(sql: str) -> str:
    return sql.replace("<envelope>", _ENVELOPE).replace("<element>", _ELEMENT)


# One document per order: lists inside an envelope, profiles, bare lists, and others, with
# absent, empty and null fields.
DOCUMENTS = _documents("""
SELECT 'doc' || CAST(o_orderkey AS STRING) || '.json' AS file,
       CASE o_orderkey % 12
         WHEN 0 THEN <envelope> || '[' || <element> || '}}, ' || <element> || ', "city": "Own"}}]}}'
         WHEN 1 THEN <envelope> || '[{{"company_name": ""}}, {{"phone": "1"}}, ' || <element> ||
                     ', "state": "XY", "website": "w.example"}}], "search_notes": "done"}}'
         WHEN 2 THEN '{{"businesses": [' || <element> || '}}]}}'
         WHEN 3 THEN '{{"task_id": null, "industry": null, "state": null, "businesses": [' ||
                     <element> || ', "city": null}}]}}'
         WHEN 4 THEN <envelope> || '[]}}'
         WHEN 5 THEN '{{"company_name": "' || c_name || '", "location": {{"city": "' || n_name ||
                     '", "state": "S", "address": null}}, "contact": {{"phone": "9", "email": ""}}, ' ||
                     '"business_details": {{"fleet_size": ' || CAST(o_custkey AS STRING) ||
                     '}}, "key_contacts": [], "task_id": "p"}}'
         WHEN 6 THEN '{{"company_name": "", "contact": {{"website": "w.example"}}}}'
         WHEN 7 THEN '[' || <element> || '}}, 5, null, "x", {{"address": "no name"}}, ' || <element> ||
                     ', "city": "' || n_name || '", "state": null}}]'
         WHEN 8 THEN '{{"note": "none of the shapes"}}'
         WHEN 9 THEN 'true'
         WHEN 10 THEN '[]'
         ELSE <envelope> || '{{}}}}' END AS value
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
     JOIN {nation} ON c_nationkey = n_nationkey
""")

# Documents and elements that cannot be used, one kind per remainder.
BAD_DOCUMENTS = _documents("""
SELECT 'doc' || CAST(o_orderkey AS STRING) || '.json' AS file,
       CASE o_orderkey % 13
         WHEN 0 THEN <envelope> || 'null}}'
         WHEN 1 THEN <envelope> || '7}}'
         WHEN 2 THEN <envelope> || '""}}'
         WHEN 3 THEN <envelope> || '[3, ' || <element> || '}}, null]}}'
         WHEN 4 THEN <envelope> || '[{{"company_name": 12}}]}}'
         WHEN 5 THEN <envelope> || '[' || <element> || ', "city": 5}}]}}'
         WHEN 6 THEN '{{"company_name": "a", "location": null}}'
         WHEN 7 THEN '{{"company_name": "a", "contact": []}}'
         WHEN 8 THEN '{{"company_name": null}}'
         WHEN 9 THEN '[' || <element> || ', "state": ["x"]}}]'
         WHEN 10 THEN '{{"cut": ' || <element>
         WHEN 11 THEN ''
         ELSE '[' || <element> || '}}]' END AS value
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
     JOIN {nation} ON c_nationkey = n_nationkey
""")


def documents(spark: SparkSession, sf_dir: str, derivation: str = DOCUMENTS) -> DataFrame:
    return parse_texts(derive(spark, sf_dir, derivation))


def elements_sql(derivation: str) -> str:
    """CTEs up to ``el``: one row per element of the documents that are JSON."""
    return f"""
WITH docs AS ({plain(derivation)}),
d AS (SELECT file, value AS v,
        CASE WHEN json_type(value) = 'OBJECT' AND json_exists(value, '$.businesses') THEN 'envelope'
             WHEN json_type(value) = 'OBJECT' AND json_exists(value, '$.company_name') THEN 'profile'
             WHEN json_type(value) = 'ARRAY' THEN 'list' END AS shape
      FROM docs WHERE json_valid(value)),
lists AS (SELECT file, v, shape,
        CASE WHEN shape = 'envelope' THEN json_extract(v, '$.businesses[*]')
             WHEN shape = 'profile' THEN [CAST(v AS JSON)]
             WHEN shape = 'list' THEN json_extract(v, '$[*]') END AS items FROM d),
el AS (SELECT file, v, shape, unnest(items) AS e,
              generate_subscripts(items, 1) - 1 AS pos FROM lists)
"""


def _place_sql(name: str) -> str:
    return f"""CASE
  WHEN shape = 'profile' THEN CASE WHEN json_exists(e, '$.location.{name}')
       THEN json_extract_string(e, '$.location.{name}') ELSE '' END
  WHEN json_exists(e, '$.{name}') THEN json_extract_string(e, '$.{name}')
  WHEN shape = 'envelope' AND json_exists(v, '$.{name}') THEN json_extract_string(v, '$.{name}')
  ELSE '' END AS {name}"""


def _contact_sql(name: str) -> str:
    home = "location" if name == "address" else "contact"
    return f"""json_extract_string(e, CASE WHEN shape = 'profile' THEN '$.{home}.{name}'
  ELSE '$.{name}' END) AS {name}"""


def _truth_sql(value: str) -> str:
    return (
        f"CASE WHEN coalesce(json_extract_string(t, '{value}'), '') IN ('', '[]', '{{}}') THEN 0 "
        f"WHEN json_type(t, '{value}') NOT IN ('VARCHAR', 'OBJECT', 'ARRAY') "
        f"AND json_extract_string(t, '{value}') = '0' THEN 0 ELSE 1 END"
    )


_COLUMNS = ["address", "phone", "website", "email"]
_ROWS_SQL = f"""{elements_sql(DOCUMENTS)},
flat AS (SELECT file, CAST(pos AS BIGINT) AS pos, shape, v, e,
  json_extract_string(e, '$.company_name') AS company_name,
  {_place_sql('city')}, {_place_sql('state')},
  {', '.join(_contact_sql(name) for name in _COLUMNS)},
  CASE WHEN shape = 'envelope' THEN CASE WHEN json_exists(v, '$.industry')
       THEN json_extract_string(v, '$.industry') ELSE '' END END AS industry,
  CASE WHEN shape <> 'list' AND json_exists(v, '$.task_id')
       THEN json_extract_string(v, '$.task_id') ELSE file END AS source_task
  FROM el WHERE json_type(e) = 'OBJECT'),
truths AS (SELECT *,
  CASE WHEN shape = 'profile' THEN json_merge_patch(json_extract(e, '$.contact'), '{{}}') ELSE e END AS t
  FROM flat WHERE shape = 'profile' OR coalesce(company_name, '') <> '')
SELECT file, pos, {', '.join(LISTING_FIELDS)},
  CAST(json_extract_string(e, '$.business_details.fleet_size') AS BIGINT) AS fleet_size,
  CAST(CASE WHEN coalesce(company_name, '') <> '' THEN 1 ELSE 0 END
    + CASE WHEN coalesce(city, '') <> '' THEN 1 ELSE 0 END
    + CASE WHEN coalesce(state, '') <> '' THEN 1 ELSE 0 END
    + CASE WHEN coalesce(address, '') <> '' THEN 1 ELSE 0 END
    + {_truth_sql('$.phone')} + {_truth_sql('$.website')} + {_truth_sql('$.email')}
    + CASE WHEN coalesce(industry, '') <> '' THEN 1 ELSE 0 END
    + CASE WHEN coalesce(source_task, '') <> '' THEN 1 ELSE 0 END
    + CASE WHEN shape = 'profile' AND json_exists(e, '$.business_details') THEN 1 ELSE 0 END
  AS BIGINT) AS filled
FROM truths
"""


@BOOK.query(_ROWS_SQL)
def normalise_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(normalise(documents(spark, sf_dir)))
    size = F.try_variant_get(F.col("extra.business_details"), "$.fleet_size", "bigint")
    return rows.select(
        "file", F.col("pos").cast("bigint").alias("pos"), *LISTING_FIELDS,
        size.alias("fleet_size"), F.col("filled").cast("bigint").alias("filled"),
    )


# What is wrong with each kind of them.
REJECTS_SQL = """
SELECT file, CAST(p AS BIGINT) AS pos, problem FROM (
  SELECT file, 0 AS p, 'businesses is not a list' AS problem FROM numbered WHERE kind IN (0, 1)
  UNION ALL SELECT file, unnest([0, 2]), 'business is not an object' FROM numbered WHERE kind = 3
  UNION ALL SELECT file, 0, 'company_name is not a text' FROM numbered WHERE kind IN (4, 8)
  UNION ALL SELECT file, 0, 'city is not a text' FROM numbered WHERE kind = 5
  UNION ALL SELECT file, 0, 'location is not an object' FROM numbered WHERE kind = 6
  UNION ALL SELECT file, 0, 'contact is not an object' FROM numbered WHERE kind = 7
  UNION ALL SELECT file, 0, 'state is not a text' FROM numbered WHERE kind = 9
  UNION ALL SELECT file, 0, CASE WHEN value = '' THEN 'empty' ELSE 'not json' END
            FROM numbered WHERE NOT json_valid(value))
"""


@BOOK.query(f"""
WITH docs AS ({plain(BAD_DOCUMENTS)}),
numbered AS (SELECT file, value, CAST(replace(replace(file, 'doc', ''), '.json', '') AS BIGINT) % 13 AS kind
             FROM docs)
{REJECTS_SQL}""")
def normalise_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rejected(normalise(documents(spark, sf_dir, BAD_DOCUMENTS)))
    return found.select("file", F.col("pos").cast("bigint").alias("pos"), "problem")


@BOOK.query(f"""{elements_sql(DOCUMENTS)}
SELECT coalesce(shape, 'none') AS shape, CAST(count(*) AS BIGINT) AS documents FROM d GROUP BY 1
""")
def document_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placebook.operators.normalise import with_elements

    rows = with_elements(readable(documents(spark, sf_dir)))
    first = rows.where("pos IS NULL OR pos = 0")
    by_shape = first.groupBy(F.coalesce("shape", F.lit("none")).alias("shape"))
    return by_shape.agg(F.count("*").alias("documents"))


@BOOK.query(f"""
WITH r AS ({plain(REPLIES)})
SELECT CASE WHEN reply = '' THEN 'empty' ELSE 'not json' END AS problem,
       CAST(count(*) AS BIGINT) AS documents
FROM r WHERE NOT json_valid(reply) GROUP BY 1
""")
def documents_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = replies(spark, sf_dir).select(
        F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("file"),
        F.col("reply").alias("value"),
    )
    return quarantined(parse_texts(texts)).groupBy("problem").agg(F.count("*").alias("documents"))
