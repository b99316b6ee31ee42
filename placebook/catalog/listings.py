"""Keys, completeness, deduplication, contact formats and the state roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.catalog.base import (
    Book,
    derive,
    filled_sql,
    key_sql,
    name_key_sql,
    pick,
    plain,
    table,
)
from placebook.functions.contacts import listing_key, name_key, standard_phone, standard_url
from placebook.functions.truth import present_variant
from placebook.operators.dedupe import dedupe, duplicate_counts, with_completeness
from placebook.operators.normalise import LISTING_FIELDS
from placebook.operators.rollup import by_state
from placebook.plans.directory import standardise_contacts

BOOK = Book()

_ENDINGS = ["", " LLC", " Inc", " Corp", " Company", " Co"]

# One listing per part. Parts share names, brands and types, so keys collide.
PART_LISTINGS = f"""
SELECT CAST(p_partkey AS BIGINT) AS ord,
       p_name || {pick('p_partkey % 6', _ENDINGS)} AS company_name,
       p_brand AS city,
       p_type AS state,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'Lot ' || CAST(p_size AS STRING) END AS address,
       CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN ''
            ELSE '555' || lpad(CAST(p_partkey AS STRING), 7, '0') END AS phone,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'shop' || CAST(p_partkey AS STRING) || '.example' END
           AS website,
       CASE WHEN p_partkey % 4 = 0 THEN NULL
            ELSE 'mail' || CAST(p_partkey AS STRING) || '@shop.example' END AS email,
       CAST(NULL AS STRING) AS industry,
       'search_' || p_type AS source_task
FROM {{part}}
"""

# One sighting per lineitem: the same businesses, seen many times with changing detail.
SIGHTINGS = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       p_name || ' ' || p_brand || {pick('(l_partkey + l_linenumber) % 6', _ENDINGS)} AS company_name,
       n_name AS city,
       CASE WHEN l_partkey % 11 = 0 THEN '' ELSE upper(r_name) END AS state,
       CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_returnflag || ' street' END AS address,
       CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE '555-' || CAST(l_suppkey AS STRING) END AS phone,
       CASE WHEN l_orderkey % 5 < 2 THEN NULL ELSE s_name || '.example' END AS website,
       CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_linestatus || '@shop.example' END AS email,
       p_type AS industry,
       'order_' || CAST(l_orderkey AS STRING) AS source_task
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
     JOIN {{supplier}} ON l_suppkey = s_suppkey
     JOIN {{nation}} ON s_nationkey = n_nationkey
     JOIN {{region}} ON n_regionkey = r_regionkey
"""
_SEEN = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def part_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_completeness(derive(spark, sf_dir, PART_LISTINGS), LISTING_FIELDS)


def part_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(part_listings(spark, sf_dir), ["ord"])


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_completeness(derive(spark, sf_dir, SIGHTINGS), LISTING_FIELDS)


def ranked_sql(derivation: str, order: list[str]) -> str:
    """CTEs up to ``ranked``, in which the winner of a key has ``rn = 1``."""
    seen = ", ".join(order)
    return f"""
WITH listing AS ({plain(derivation)}),
keyed AS (
  SELECT *, {key_sql('company_name', 'city', 'state')} AS listing_key,
         {filled_sql(LISTING_FIELDS)} AS filled
  FROM listing),
ranked AS (
  SELECT *,
         row_number() OVER (PARTITION BY listing_key ORDER BY filled DESC, {seen}) AS rn,
         row_number() OVER (PARTITION BY listing_key ORDER BY {seen}) AS seen_rn,
         count(*) OVER (PARTITION BY listing_key) AS sightings
  FROM keyed)
"""


_WINNER_FIELDS = ", ".join(f"w.{name}" for name in LISTING_FIELDS)
WINNERS_SQL = f"""{ranked_sql(PART_LISTINGS, ['ord'])}
SELECT {_WINNER_FIELDS}, w.listing_key, w.ord, CAST(w.filled AS BIGINT) AS filled,
       f.ord AS first_seen, CAST(w.sightings AS BIGINT) AS sightings
FROM ranked w JOIN ranked f ON w.listing_key = f.listing_key
WHERE w.rn = 1 AND f.seen_rn = 1
"""


@BOOK.query(WINNERS_SQL)
def dedupe_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_winners(spark, sf_dir).select(
        *LISTING_FIELDS, "listing_key", "ord", F.col("filled").cast("bigint").alias("filled"),
        F.col("first_seen.ord").alias("first_seen"), "sightings",
    )


@BOOK.query(f"""{ranked_sql(SIGHTINGS, _SEEN)}
SELECT listing_key, company_name, address, phone, website, email, industry, source_task,
       CAST(filled AS BIGINT) AS filled, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(sightings AS BIGINT) AS sightings
FROM ranked WHERE rn = 1
""")
def dedupe_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(sightings(spark, sf_dir), _SEEN).select(
        "listing_key", "company_name", "address", "phone", "website", "email", "industry",
        "source_task", F.col("filled").cast("bigint").alias("filled"), "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "sightings",
    )


@BOOK.query(f"""{ranked_sql(SIGHTINGS, _SEEN)}
SELECT CAST(count(*) AS BIGINT) AS total_records_found,
       CAST(count(DISTINCT listing_key) AS BIGINT) AS unique_records,
       CAST(count(*) - count(DISTINCT listing_key) AS BIGINT) AS duplicates_removed
FROM ranked
""")
def dedupe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_counts(dedupe(sightings(spark, sf_dir), _SEEN))


# Names with endings at the end, inside words, doubled, and with blanks around them.
_NAMES = f"""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey,
       CASE p_partkey % 8
            WHEN 0 THEN '  ' || p_name || ' LLC  '
            WHEN 1 THEN p_name || ' County Corporation'
            WHEN 2 THEN upper(p_name) || ', Inc.'
            WHEN 3 THEN p_name || ' Inc LLC'
            WHEN 4 THEN 'The Coast ' || p_name || ' Co'
            WHEN 5 THEN NULL
            WHEN 6 THEN p_name || ' Incorporated Company'
            ELSE p_name END AS company_name,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS city,
       lower(p_type) AS state
FROM {{part}}
"""


@BOOK.query(f"""
SELECT p_partkey, {name_key_sql('company_name')} AS name_key,
       {key_sql('company_name', 'city', 'state')} AS listing_key
FROM ({plain(_NAMES)})
""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, _NAMES).select(
        "p_partkey",
        name_key(F.col("company_name")).alias("name_key"),
        listing_key(F.col("company_name"), F.col("city"), F.col("state")).alias("listing_key"),
    )


@BOOK.query(f"""
WITH listing AS ({plain(SIGHTINGS)})
SELECT filled, CAST(count(*) AS BIGINT) AS listings
FROM (SELECT CAST({filled_sql(LISTING_FIELDS)} AS BIGINT) AS filled FROM listing)
GROUP BY filled
""")
def completeness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = sightings(spark, sf_dir)
    by_score = scored.groupBy(F.col("filled").cast("bigint").alias("filled"))
    return by_score.agg(F.count("*").alias("listings"))


@BOOK.query(f"""
WITH listing AS ({plain(SIGHTINGS)})
SELECT CASE WHEN coalesce(state, '') = '' THEN 'Unknown' ELSE state END AS state,
       CAST(count(DISTINCT CASE WHEN city <> '' THEN city END) AS BIGINT) AS cities,
       CAST(count(*) AS BIGINT) AS businesses
FROM listing GROUP BY 1
""")
def state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_state(derive(spark, sf_dir, SIGHTINGS))


_DIGITS = "lpad(CAST(c_custkey * 7919 % 10000000 AS STRING), 7, '0')"
_PHONES = f"""
SELECT c_custkey,
       CASE c_custkey % 9
            WHEN 0 THEN '817' || {_DIGITS}
            WHEN 1 THEN '1-800-' || substr({_DIGITS}, 1, 3) || '-' || substr({_DIGITS}, 4, 4)
            WHEN 2 THEN '(713) ' || substr({_DIGITS}, 1, 3) || '.' || substr({_DIGITS}, 4, 4)
            WHEN 3 THEN '+44 20 ' || {_DIGITS} || ' 9'
            WHEN 4 THEN '2123' || {_DIGITS}
            WHEN 5 THEN substr({_DIGITS}, 1, 3)
            WHEN 6 THEN trim(substr('        ' || {_DIGITS}, CAST(c_custkey % 8 AS INT), 8))
            WHEN 7 THEN nullif('+' || {_DIGITS}, '+0007919')
            ELSE c_name END AS phone
FROM {{customer}}
"""


@BOOK.query(f"""
WITH p AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM ({plain(_PHONES)}))
SELECT c_custkey, phone,
       CASE WHEN coalesce(phone, '') = '' THEN NULL
            WHEN length(d) = 10
            THEN '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4)
            WHEN length(d) = 11 AND substr(d, 1, 1) = '1'
            THEN '(' || substr(d, 2, 3) || ') ' || substr(d, 5, 3) || '-' || substr(d, 8, 4)
            ELSE phone END AS standard
FROM p
""")
def phone_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    phones = derive(spark, sf_dir, _PHONES)
    return phones.withColumn("standard", standard_phone(F.col("phone")))


_URLS = """
SELECT page_id,
       CASE page_id % 8
            WHEN 0 THEN url
            WHEN 1 THEN regexp_replace(url, '^https?://', '')
            WHEN 2 THEN '  ' || url || '   '
            WHEN 3 THEN upper(url)
            WHEN 4 THEN 'ftp://' || regexp_replace(url, '^https?://', '')
            WHEN 5 THEN ' ' || regexp_replace(url, '^https?://', '')
            WHEN 6 THEN regexp_replace(url, '^http', 'HTTP') || ' '
            ELSE replace(url, 'https://', 'http:///') END AS url
FROM {pages}
"""


@BOOK.query(f"""
SELECT page_id, url,
       CASE WHEN coalesce(url, '') = '' THEN NULL
            WHEN trim(url) LIKE 'http://%' OR trim(url) LIKE 'https://%' THEN trim(url)
            ELSE 'https://' || trim(url) END AS standard
FROM ({plain(_URLS)})
""")
def url_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, _URLS).withColumn("standard", standard_url(F.col("url")))


@BOOK.query(f"""
SELECT ord, CASE WHEN coalesce(website, '') = '' THEN NULL ELSE 'https://' || website END AS website,
       CASE WHEN coalesce(phone, '') = '' THEN NULL
            ELSE '(' || substr(phone, 1, 3) || ') ' || substr(phone, 4, 3) || '-' || substr(phone, 7, 4)
            END AS phone
FROM ({plain(PART_LISTINGS)})
""")
def contacts_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardise_contacts(derive(spark, sf_dir, PART_LISTINGS)).select(
        "ord", "website", "phone"
    )


@BOOK.query("""
SELECT CAST(event_id AS BIGINT) AS event_id,
       CASE event_id % 9 WHEN 0 THEN FALSE WHEN 1 THEN FALSE WHEN 2 THEN user_id % 3 <> 0
            WHEN 3 THEN user_id % 2 = 0 WHEN 4 THEN FALSE WHEN 5 THEN FALSE WHEN 6 THEN TRUE
            WHEN 7 THEN TRUE ELSE event_type <> 'click' END AS present
FROM events
""")
def truth_of_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """CASE event_id % 9 WHEN 0 THEN 'null' WHEN 1 THEN '""'
        WHEN 2 THEN CAST(user_id % 3 AS STRING)
        WHEN 3 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END
        WHEN 4 THEN '[]' WHEN 5 THEN '{}' WHEN 6 THEN '"0"' WHEN 7 THEN '[0]'
        ELSE CASE WHEN event_type <> 'click' THEN props ELSE '-0.0' END END"""
    values = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.parse_json(F.expr(text)).alias("v"),
    )
    return values.select("event_id", F.expr(present_variant("v")).alias("present"))
