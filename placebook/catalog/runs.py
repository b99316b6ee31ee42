"""Running tasks, their statistics, and whole runs."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.catalog.base import Book, derive, plain
from placebook.catalog.listings import part_listings
from placebook.catalog.texts import valid_sql, widest_sql
from placebook.fixed_values import MAJOR_CITIES
from placebook.operators.dedupe import dedupe, duplicate_counts
from placebook.operators.enrich import run_kept, run_tasks, save_results, with_payload
from placebook.operators.rollup import failed_tasks, run_stats, run_summary
from placebook.plans.research import Research, run_research
from placebook.session import fresh_path

BOOK = Book()

# Every user turn is a task; its recorded reply is the turn of the assistant that follows.
_TURNS = """
SELECT CAST(u.conv_id AS STRING) || '-' || CAST(u.turn AS STRING) AS task_id,
       u.text AS prompt, a.text AS recorded
FROM {conversations} u LEFT JOIN {conversations} a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'
"""


def _replay() -> Callable[[dict], str]:
    """Work that gives the recorded reply. An inner function travels to workers as it is."""

    def work(task: dict) -> str:
        if task["recorded"] is None:
            raise LookupError("no recorded reply")
        return task["recorded"]

    return work


@BOOK.query(f"""
SELECT task_id, recorded IS NOT NULL AS success, recorded AS output,
       CASE WHEN recorded IS NULL THEN 'no recorded reply' END AS error, TRUE AS timed
FROM ({plain(_TURNS)})""")
def enrich_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = run_tasks(derive(spark, sf_dir, _TURNS), _replay(), concurrency=8)
    kept = save_results(results, fresh_path(spark, "results"))
    timed = F.col("execution_time") >= 0
    return kept.select("task_id", "success", "output", "error", timed.alias("timed"))


# How often each task has to be asked: by the length of its prompt.
_TRIES = """
SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS task_key,
       CAST(conv_id AS STRING) AS task_id, text AS prompt, length(text) % 4 + 1 AS needed
FROM {conversations} WHERE role = 'user'
"""


def _stubborn() -> Callable[[dict], str]:
    """Work that fails until a task is asked for the attempt it needs."""

    def work(task: dict) -> str:
        if task["attempt"] < task["needed"]:
            raise ConnectionError(f"attempt {task['attempt']} of {task['needed']}")
        return task["prompt"]

    return work


@BOOK.query(f"""
SELECT task_key, needed <= 3 AS success, CASE WHEN needed <= 3 THEN prompt END AS output,
       CAST(least(needed, 3) AS INTEGER) AS attempt FROM ({plain(_TRIES)})""")
def enrich_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt first, then two more for what failed; a success is not asked again."""
    tasks, path = derive(spark, sf_dir, _TRIES), fresh_path(spark, "attempts")
    run_kept(tasks, _stubborn(), 8, path)
    return run_kept(tasks, _stubborn(), 8, path, attempts=3).select("task_key", "success", "output", "attempt")


# Recorded replies with a list of their own facts behind them.
_ANSWERS = f"""
SELECT task_id, prompt, CASE WHEN recorded IS NOT NULL THEN recorded ||
  '[{{{{"turns": ' || CAST(length(recorded) AS STRING) || '}}}}, {{{{"id": "' || task_id || '"}}}}]' END AS recorded
FROM ({_TURNS})
"""


@BOOK.query(f"""
WITH r AS ({plain(_ANSWERS)}),
found AS (SELECT task_id, coalesce({valid_sql("recorded")}, {valid_sql(widest_sql("recorded", "[", "]"))},
    {valid_sql(widest_sql("recorded", "{", "}"))}) AS p FROM r WHERE recorded IS NOT NULL)
SELECT task_id, CASE WHEN json_type(p) = 'ARRAY' THEN CAST(json_array_length(p) AS BIGINT) END AS items,
       TRY_CAST(json_extract_string(p, '$[0].turns') AS BIGINT) AS turns, json_extract_string(p, '$[1].id') AS id
FROM found""")
def successful_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = run_tasks(derive(spark, sf_dir, _ANSWERS), _replay(), concurrency=8)
    found = with_payload(save_results(results, fresh_path(spark, "results")))
    return found.select(
        "task_id",
        F.array_size(F.try_variant_get("payload", "$", "array<variant>")).cast("bigint").alias("items"),
        F.try_variant_get("payload", "$[0].turns", "bigint").alias("turns"),
        F.try_variant_get("payload", "$[1].id", "string").alias("id"),
    )


# Events as task results.
_RESULTS = """
SELECT CAST(event_id AS STRING) AS task_id, event_type <> 'error' AS success,
       value AS execution_time
FROM {events}
"""
_STATS_SQL = """CAST(count(*) AS BIGINT) AS total_tasks,
  CAST(count(*) FILTER (WHERE success) AS BIGINT) AS successful,
  CAST(count(*) FILTER (WHERE NOT success) AS BIGINT) AS failed,
  round(count(*) FILTER (WHERE success) / count(*) * 100, 4) AS success_rate,
  round(sum(execution_time), 2) AS total_time, round(avg(execution_time), 4) AS average_time"""


@BOOK.query(f"SELECT {_STATS_SQL} FROM ({plain(_RESULTS)})")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = run_stats(derive(spark, sf_dir, _RESULTS))
    rounded = {"success_rate": 4, "total_time": 2, "average_time": 4}
    return stats.withColumns({name: F.round(name, places) for name, places in rounded.items()})


@BOOK.query("SELECT CAST(event_id AS STRING) AS task_id FROM events WHERE event_type = 'error'")
def failed_task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_tasks(derive(spark, sf_dir, _RESULTS))


@BOOK.query(f"""
WITH r AS (SELECT {_STATS_SQL} FROM ({plain(_RESULTS)}))
SELECT (SELECT array_to_string(list_sort(list(DISTINCT p_type)), ',') FROM part) AS states_researched,
       CAST((SELECT count(*) FROM part) AS BIGINT) AS tasks_generated,
       total_tasks AS tasks_executed, successful AS tasks_successful, failed AS tasks_failed,
       total_time AS execution_time,
       CAST((SELECT count(*) FROM part) AS BIGINT) AS total_records_found
FROM r""")
def run_summary_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = part_listings(spark, sf_dir)
    planned = found.agg(
        F.array_sort(F.collect_set("state")).alias("states_researched"),
        F.count("*").alias("tasks_generated"),
    )
    aggregation = duplicate_counts(dedupe(found, ["ord"]))
    stats = run_stats(derive(spark, sf_dir, _RESULTS))
    summary = run_summary(stats, planned, aggregation)
    return summary.select(
        F.array_join("states_researched", ",").alias("states_researched"), "tasks_generated",
        "tasks_executed", "tasks_successful", "tasks_failed",
        F.round("execution_time", 2).alias("execution_time"),
        F.col("aggregation.total_records_found").alias("total_records_found"),
    )


# One request per supplier, for one or two states; replies are made from the task itself.
_SUPPLIER_REQUESTS = """
SELECT s_name AS target_id, CASE WHEN s_suppkey % 2 = 0 THEN 'TX' ELSE 'NY, GA' END AS states,
       n_name AS industry, CAST(NULL AS ARRAY<STRING>) AS search_terms,
       CAST(NULL AS ARRAY<STRING>) AS data_fields
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""


def _invent() -> Callable[[dict], str]:
    """Work that replies as a searcher does: prose, then an envelope with two businesses."""

    def work(task: dict) -> str:
        if task["city"] == "Albany":
            raise TimeoutError("timed out")
        names = [f"{task['target_id']} {task['industry']} Inc", f"{task['city']} Co"]
        envelope = {key: task[key] for key in ("task_id", "city", "state", "industry")}
        envelope["businesses"] = [{"company_name": name, "phone": None} for name in names]
        return f"I will search in {task['city']}.\n{json.dumps(envelope)}"

    return work


_CITY_ROWS = ", ".join(f"('{state}', '{city}')" for state, cities in MAJOR_CITIES.items() for city in cities)
_WANTED_SQL = f"""
WITH cities(state, city) AS (VALUES {_CITY_ROWS}),
wanted AS (SELECT s_name, n_name, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['TX'] ELSE ['NY', 'GA'] END) AS state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
tasks AS (SELECT s_name, n_name, w.state, city FROM wanted w JOIN cities c ON w.state = c.state),
good AS (SELECT * FROM tasks WHERE city <> 'Albany')
"""


def _research(spark: SparkSession, sf_dir: str, **options) -> Research:
    requests = derive(spark, sf_dir, _SUPPLIER_REQUESTS)
    instructions = derive(
        spark, sf_dir, "SELECT 'city_search' AS task_type, 'Of ' || CAST(sum(length(text)) AS STRING) AS text FROM {documents}"
    )
    return run_research(
        requests, instructions, _invent(), fresh_path(spark, "research"), "first", concurrency=8, **options
    )


@BOOK.query(f"""{_WANTED_SQL}
SELECT CAST((SELECT count(*) FROM tasks) AS BIGINT) AS tasks_generated,
       CAST((SELECT count(*) FROM tasks) AS BIGINT) AS tasks_executed,
       CAST(count(*) AS BIGINT) AS tasks_successful,
       CAST((SELECT count(*) FROM tasks) - count(*) AS BIGINT) AS tasks_failed,
       CAST(count(*) AS BIGINT) AS input_files, CAST(2 * count(*) AS BIGINT) AS total_records_found,
       CAST(count(DISTINCT s_name) + count(DISTINCT city) AS BIGINT) AS unique_records,
       CAST(2 * count(*) - count(DISTINCT s_name) - count(DISTINCT city) AS BIGINT) AS duplicates_removed
FROM good""")
def research_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _research(spark, sf_dir)
    counters = ["tasks_generated", "tasks_executed", "tasks_successful", "tasks_failed"]
    return run.summary.select(*counters, "aggregation.*")


@BOOK.query(f"""{_WANTED_SQL}
SELECT s_name || ' ' || n_name || ' Inc' AS company_name, city, state, CAST(1 AS BIGINT) AS sightings FROM good
UNION ALL SELECT city || ' Co', city, state, CAST(count(*) AS BIGINT) FROM good GROUP BY city, state""")
def research_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target has its business in each of its cities: no reply is lost to another target."""
    businesses = _research(spark, sf_dir, prefer="outermost").directory.businesses
    return businesses.select("company_name", "city", "state", "sightings")


# One request per customer; the planner names tasks of two types for most of them.
_CUSTOMER_REQUESTS = """
SELECT CAST(c_custkey AS STRING) AS target_id, CASE c_custkey % 8 WHEN 7 THEN 'XX' WHEN 4 THEN 'TX, CA' ELSE 'TX' END AS states,
       c_mktsegment AS industry, CAST(NULL AS ARRAY<STRING>) AS search_terms,
       CAST(NULL AS ARRAY<STRING>) AS data_fields
FROM {customer}
"""


def _plan_and_answer() -> Callable[[dict], str]:
    """Work that first plans, then replies to a city search or to a company's research."""

    def work(task: dict) -> str:
        number = int(task["target_id"])
        if task["task_type"] == "planning":
            if number % 8 == 6:
                raise TimeoutError("timed out")
            city = {"city": f"City {number % 5}", "state": "TX"}
            plan = [{"task_type": "company_research", "company_name": f"Firm {number}", **city}, {"task_id": "c", **city}]
            if number % 8 == 5:  # prose without a list, or an empty list
                return ["No plan.", "[]", "Nothing: []"][number % 3]
            return f"Here it is:\n{json.dumps(plan)}\n"
        place = {"city": task["city"], "state": task["state"]}
        if task["task_type"] == "company_research":
            return json.dumps({"company_name": task["company_name"], "location": place, "contact": {"phone": "1"}})
        found = [{"company_name": f"{task['industry']} of {task['city']}"}]
        return json.dumps({"task_id": task["task_id"], **place, "businesses": found})

    return work


@BOOK.query("""
WITH good AS (SELECT c_custkey, c_mktsegment, 'City ' || CAST(c_custkey % 5 AS STRING) AS city
  FROM customer WHERE c_custkey % 8 < 5)
SELECT 'Firm ' || CAST(c_custkey AS STRING) AS company_name, city, 'TX' AS state, '1' AS phone,
       CAST(1 AS BIGINT) AS sightings FROM good
UNION ALL SELECT c_mktsegment || ' of ' || city, city, 'TX', NULL, CAST(count(*) AS BIGINT)
FROM good GROUP BY c_mktsegment, city""")
def planned_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).directory.businesses.select("company_name", "city", "state", "phone", "sightings")


@BOOK.query("""
SELECT CAST(c_custkey AS STRING) AS target_id, CASE c_custkey % 8 WHEN 7 THEN 'XX' WHEN 4 THEN 'CA' END AS state,
       CASE c_custkey % 8 WHEN 7 THEN 'unknown state' WHEN 6 THEN 'no plan: timed out' WHEN 5 THEN 'no task in plan'
         ELSE 'no task for this state' END AS reason
FROM customer WHERE c_custkey % 8 > 3""")
def planned_run_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request has a task or a reason; plans name tasks in TX only."""
    return _planned(spark, sf_dir, skip_aggregation=True).rejected


def _planned(spark: SparkSession, sf_dir: str, **options) -> Research:
    requests = derive(spark, sf_dir, _CUSTOMER_REQUESTS)
    none = derive(spark, sf_dir, "SELECT CAST(r_name AS STRING) AS task_type, r_name AS text FROM {region}")
    return run_research(
        requests, none, _plan_and_answer(), fresh_path(spark, "planned"), "p", concurrency=8,
        ask_planner=True, prefer="outermost", **options
    )
