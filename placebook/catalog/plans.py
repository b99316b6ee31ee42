"""States, cities, targets, tasks and their prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.catalog.base import Book, derive, pick, plain, quoted, table
from placebook.fixed_values import (
    CITY_SEARCH_PROMPT,
    COMPANY_RESEARCH_PROMPT,
    DEFAULT_DATA_FIELDS,
    DEFAULT_INDUSTRY,
    INSTRUCTION_DIVIDER,
    MAJOR_CITIES,
    MINIMUM_CITIES,
    PLANNER_PROMPT,
    SEARCH_PATTERNS,
    STATES,
    WEB_MARK,
)
from placebook.functions.contacts import joined
from placebook.operators import planning
from placebook.operators.planning import (
    accepted_requests,
    expand_queries,
    full_prompt,
    parse_states,
    plan_tasks,
    planner_prompt,
    tasks_from_replies,
    uncovered_states,
    validate_states,
    with_instructions,
    with_major_cities,
    with_prompts,
    with_state_name,
    with_task_defaults,
)
from placebook.sources.targets import scaffold_targets, with_target_defaults

BOOK = Book()

_CODES = [code for code, _ in STATES]

# One request per customer: up to three states in untidy writing, some of them unknown.
REQUESTS = f"""
SELECT CAST(c_custkey AS STRING) AS target_id,
       CASE c_custkey % 4
         WHEN 0 THEN lower({pick('c_custkey % 51', _CODES)})
         WHEN 1 THEN ' tx , ' || {pick('c_custkey % 51', _CODES)} || ',Fl'
         WHEN 2 THEN 'CA,' || substr(c_mktsegment, 1, 2)
         ELSE {pick('c_custkey % 51', _CODES)} || ',NY' END AS states,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS industry,
       CASE WHEN c_custkey % 3 = 0 THEN NULL
            ELSE array_of(lower(c_mktsegment), c_name) END AS search_terms,
       CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE array_of('company_name', 'phone') END AS data_fields
FROM {{customer}}
"""


def _spark_text(sql: str) -> str:
    return sql.replace("array_of(", "array(")


def _duck_text(sql: str) -> str:
    return plain(sql).replace("array_of(", "list_value(")


def _sql_list(values: list[str]) -> str:
    return f"[{', '.join(quoted(value) for value in values)}]"


_STATE_ROWS = ", ".join(f"({quoted(code)}, {quoted(name)})" for code, name in STATES)
_CITY_ROWS = ", ".join(
    f"({quoted(state)}, {quoted(city)}, {rank}, {str(rank <= MINIMUM_CITIES[state])})"
    for state, cities in MAJOR_CITIES.items()
    for rank, city in enumerate(cities, 1)
)
_BASE_SQL = f"""
WITH state_names(code, name) AS (VALUES {_STATE_ROWS}),
cities(city_state, city, city_rank, required) AS (VALUES {_CITY_ROWS}),
raw AS ({_duck_text(REQUESTS)}),
requests AS (SELECT target_id, states, coalesce(industry, {quoted(DEFAULT_INDUSTRY)}) AS industry,
    coalesce(search_terms, [coalesce(industry, {quoted(DEFAULT_INDUSTRY)})]) AS search_terms,
    coalesce(data_fields, {_sql_list(DEFAULT_DATA_FIELDS)}) AS data_fields FROM raw),
codes AS (SELECT target_id, industry, search_terms, data_fields,
    CAST(generate_subscripts(string_split(states, ','), 1) - 1 AS INTEGER) AS state_pos,
    upper(trim(unnest(string_split(states, ',')))) AS state FROM requests),
accepted AS (SELECT * FROM codes WHERE target_id NOT IN
    (SELECT target_id FROM codes WHERE state NOT IN (SELECT code FROM state_names))),
tasks AS (SELECT target_id, state_pos, state, city, industry, search_terms, data_fields,
    'search_' || state || '_' || replace(city, ' ', '') AS task_id, 'city_search' AS task_type,
    required FROM accepted JOIN cities ON state = city_state)
"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_target_defaults(derive(spark, sf_dir, _spark_text(REQUESTS)))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_states(_requests(spark, sf_dir))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted_requests(_requests(spark, sf_dir))


def _tasks(spark: SparkSession, sf_dir: str, required_only: bool = False) -> DataFrame:
    return plan_tasks(_accepted(spark, sf_dir), required_only=required_only)


@BOOK.query(f"{_BASE_SQL} SELECT target_id, state_pos, state FROM codes")
def parsed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("target_id", "state_pos", "state")


@BOOK.query(f"""{_BASE_SQL}
SELECT target_id, state_pos, state FROM codes WHERE state IN (SELECT code FROM state_names)""")
def valid_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_states(_codes(spark, sf_dir))[0].select("target_id", "state_pos", "state")


@BOOK.query(f"""{_BASE_SQL}
SELECT target_id, state_pos, state FROM codes WHERE state NOT IN (SELECT code FROM state_names)""")
def rejected_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_states(_codes(spark, sf_dir))[1].select("target_id", "state_pos", "state")


@BOOK.query(f"{_BASE_SQL} SELECT target_id, state_pos, state FROM accepted")
def accepted_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir).select("target_id", "state_pos", "state")


# Every seventh request has no list of states.
_SOME_WITHOUT = f"""
SELECT target_id, CASE WHEN CAST(target_id AS INT) % 7 = 0 THEN NULL ELSE states END AS states
FROM ({REQUESTS})
"""


@BOOK.query(f"""{_BASE_SQL}, gaps AS (SELECT target_id,
    CASE WHEN CAST(target_id AS INT) % 7 = 0 THEN NULL ELSE states END AS states FROM raw)
SELECT target_id, CAST(NULL AS VARCHAR) AS state, 'no states given' AS reason FROM gaps WHERE states IS NULL
UNION ALL SELECT target_id, state, 'unknown state' FROM
  (SELECT target_id, upper(trim(unnest(string_split(states, ',')))) AS state FROM gaps WHERE states IS NOT NULL)
  WHERE state NOT IN (SELECT code FROM state_names)""")
def rejected_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.rejected_requests(derive(spark, sf_dir, _spark_text(_SOME_WITHOUT)))


@BOOK.query(f"""{_BASE_SQL}
SELECT target_id, state, 'no cities known' AS reason FROM accepted
WHERE state NOT IN (SELECT city_state FROM cities)""")
def states_without_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uncovered_states(_accepted(spark, sf_dir))


@BOOK.query(f"""{_BASE_SQL}
SELECT target_id, state_pos, state, name AS state_name
FROM codes LEFT JOIN state_names ON state = code""")
def state_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = with_state_name(_codes(spark, sf_dir))
    return named.select("target_id", "state_pos", "state", "state_name")


@BOOK.query(f"""{_BASE_SQL}
SELECT target_id, state_pos, city, CAST(city_rank AS INTEGER) AS city_rank
FROM codes JOIN cities ON state = city_state""")
def major_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = _codes(spark, sf_dir).withColumn("state", F.lower("state"))
    return with_major_cities(lower).select("target_id", "state_pos", "city", "city_rank")


@BOOK.query(f"""{_BASE_SQL}
SELECT target_id, state_pos, city FROM codes JOIN cities ON state = city_state WHERE required""")
def minimum_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_major_cities(_codes(spark, sf_dir), required=True)
    return found.select("target_id", "state_pos", "city")


_TASK_COLUMNS = ["target_id", "state_pos", "task_id", "task_type", "state", "city", "industry"]


@BOOK.query(f"""{_BASE_SQL}
SELECT {', '.join(_TASK_COLUMNS)}, array_to_string(search_terms, ', ') AS terms,
       array_to_string(data_fields, ', ') AS fields
FROM tasks""")
def city_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(spark, sf_dir).select(
        *_TASK_COLUMNS,
        joined(F.col("search_terms")).alias("terms"),
        joined(F.col("data_fields")).alias("fields"),
    )


@BOOK.query(f"{_BASE_SQL} SELECT target_id, state_pos, task_id FROM tasks WHERE required")
def minimum_city_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(spark, sf_dir, required_only=True).select("target_id", "state_pos", "task_id")


@BOOK.query(f"""{_BASE_SQL}
SELECT target_id || '~' || CAST(state_pos AS STRING) || '~' || state || '~' || city AS task_key, task_id FROM tasks""")
def all_city_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(spark, sf_dir).select("task_key", "task_id")


# The caller's own cities: every nation name, in a state chosen by its number.
_OWN_CITIES = f"""
SELECT {pick('n_nationkey', _CODES)} AS state, n_name || ' Springs' AS city FROM {{nation}}
"""


@BOOK.query(f"""{_BASE_SQL}
SELECT target_id, a.state, o.city,
       'search_' || a.state || '_' || replace(o.city, ' ', '') AS task_id
FROM accepted a JOIN ({plain(_OWN_CITIES)}) o ON a.state = o.state""")
def city_tasks_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = plan_tasks(_accepted(spark, sf_dir), derive(spark, sf_dir, _OWN_CITIES))
    return tasks.select("target_id", "state", "city", "task_id")


def _filled_sql(pattern: str, names: list[str]) -> str:
    """The pattern with each name replaced; the values hold no braces."""
    sql = quoted(pattern)
    for name, value in names.items() if isinstance(names, dict) else [(n, n) for n in names]:
        sql = f"replace({sql}, '{{{name}}}', coalesce({value}, ''))"
    return sql


_PHRASES = ", ".join(
    _filled_sql(pattern, ["search_term", "city", "state"]) for pattern in SEARCH_PATTERNS
)


@BOOK.query(f"""{_BASE_SQL},
by_term AS (SELECT target_id, state_pos, task_id, city, state,
                   unnest(search_terms) AS search_term FROM tasks)
SELECT target_id, state_pos, task_id, search_term, unnest([{_PHRASES}]) AS query FROM by_term""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    expanded = expand_queries(_tasks(spark, sf_dir))
    return expanded.select("target_id", "state_pos", "task_id", "search_term", "query")


@BOOK.query(f"""{_BASE_SQL}
SELECT target_id, industry, array_to_string(search_terms, ', ') AS terms,
       array_to_string(data_fields, ', ') AS fields FROM requests""")
def target_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select(
        "target_id", "industry",
        joined(F.col("search_terms")).alias("terms"),
        joined(F.col("data_fields")).alias("fields"),
    )


@BOOK.query(f"""
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, industry,
       array_to_string([lower(industry), lower(industry) || ' company',
                        lower(industry) || ' services', lower(industry) || ' provider'], '; ') AS terms,
       {quoted('; '.join(DEFAULT_DATA_FIELDS))} AS fields
FROM (SELECT c_custkey, c_mktsegment || ' ' || c_name AS industry FROM customer)""")
def target_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    industries = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"),
        F.concat_ws(" ", "c_mktsegment", "c_name").alias("industry"),
    )
    return scaffold_targets(industries).select(
        "c_custkey", "industry",
        F.array_join("search_terms", "; ").alias("terms"),
        F.array_join("data_fields", "; ").alias("fields"),
    )


_PLANNER = {
    "industry": "industry",
    "states": "array_to_string(list_transform(string_split(states, ','), lambda s: upper(trim(s))), ', ')",
    "search_terms": "array_to_string(search_terms, ', ')",
    "data_fields": "array_to_string(data_fields, ', ')",
}


@BOOK.query(f"{_BASE_SQL} SELECT target_id, {_filled_sql(PLANNER_PROMPT, _PLANNER)} AS prompt FROM requests")
def planner_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner_prompt(_requests(spark, sf_dir)).select("target_id", "prompt")


# Tasks of three types, a third of them for single companies, and some of a type of their own.
_MIXED = """
SELECT CAST(s_suppkey AS BIGINT) AS pos,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'task-' || s_name END AS task_id,
       CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'company_research' WHEN 2 THEN 'city_search'
            WHEN 3 THEN 'review' ELSE 'company_research' END AS task_type,
       s_name AS company_name, n_name AS city,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE substr(r_name, 1, 2) END AS state,
       r_name AS industry
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""
_MIXED_SQL = f"""
mixed AS (SELECT pos, coalesce(task_id, 'task_' || CAST(pos AS STRING)) AS task_id,
    coalesce(task_type, 'city_search') AS task_type, company_name, city, state, industry
  FROM ({plain(_MIXED)}))
"""
_FIELDS = ["task_id", "task_type", "company_name", "city", "state", "industry"]
# Only ``state`` may be null; a null member is left out.
_MEMBERS = ", ".join(f"""'"{name}": "' || {name} || '"'""" for name in _FIELDS)
_AS_JSON = f"array_to_string(list_filter([{_MEMBERS}], lambda m: m IS NOT NULL), ', ')"
_COMPANY = ["company_name", "city", "state", "industry", "task_id"]
_CITY = {
    "city": "city", "state": "state", "industry": "industry", "task_id": "task_id",
    "search_terms": "''", "data_fields": "''",
}
_PROMPT_SQL = f"""CASE task_type
  WHEN 'city_search' THEN {_filled_sql(CITY_SEARCH_PROMPT, _CITY)}
  WHEN 'company_research' THEN {_filled_sql(COMPANY_RESEARCH_PROMPT, _COMPANY)}
  ELSE '{{' || {_AS_JSON} || '}}' END"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_task_defaults(derive(spark, sf_dir, _MIXED), "pos")


@BOOK.query(f"WITH {_MIXED_SQL} SELECT pos, task_id, task_type FROM mixed")
def task_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select("pos", "task_id", "task_type")


@BOOK.query(f"WITH {_MIXED_SQL} SELECT pos, task_type, {_PROMPT_SQL} AS prompt FROM mixed")
def task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_prompts(_mixed(spark, sf_dir)).select("pos", "task_type", "prompt")


_CITY_PROMPT = _CITY | {
    "search_terms": "array_to_string(search_terms, ', ')",
    "data_fields": "array_to_string(data_fields, ', ')",
}


@BOOK.query(f"""{_BASE_SQL}
SELECT target_id, state_pos, {_filled_sql(CITY_SEARCH_PROMPT, _CITY_PROMPT)} AS prompt FROM tasks""")
def city_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_prompts(_tasks(spark, sf_dir)).select("target_id", "state_pos", "prompt")


# Instructions as a table: one per language, told from all of its documents.
_INSTRUCTIONS = """
SELECT CASE lang WHEN 'en' THEN 'city_search' WHEN 'de' THEN 'company_research'
                 WHEN 'fr' THEN 'review' ELSE lang END AS task_type,
       'Read ' || CAST(count(*) AS STRING) || ' documents of ' || CAST(sum(length(text)) AS STRING) ||
       ' characters.' AS text
FROM {documents} GROUP BY 1
"""
_CHOSEN_SQL = f"""
WITH {_MIXED_SQL}, instructions AS ({plain(_INSTRUCTIONS)}),
chosen AS (SELECT m.*, coalesce(i.text, f.text, '') AS instruction
  FROM mixed m LEFT JOIN instructions i ON m.task_type = i.task_type
  LEFT JOIN instructions f ON f.task_type = 'city_search')
"""


@BOOK.query(f"""{_CHOSEN_SQL}
SELECT pos, CAST(length(prompt) AS BIGINT) AS characters, md5(prompt) AS digest
FROM (SELECT pos, CASE WHEN instruction <> '' THEN instruction || {quoted(INSTRUCTION_DIVIDER)} ELSE '' END
                  || {quoted(WEB_MARK)} || {_PROMPT_SQL} AS prompt FROM chosen)""")
def instruction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    instructions = derive(spark, sf_dir, _INSTRUCTIONS)
    tasks = with_instructions(with_prompts(_mixed(spark, sf_dir)), instructions)
    prompt = full_prompt(F.col("prompt"), F.col("instruction"), web=True)
    return tasks.select("pos", prompt.alias("prompt")).select(
        "pos", F.length("prompt").cast("bigint").alias("characters"),
        F.md5("prompt").alias("digest"),
    )


@BOOK.query(f"{_CHOSEN_SQL} SELECT pos, task_type, instruction FROM chosen")
def instruction_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = with_instructions(_mixed(spark, sf_dir), derive(spark, sf_dir, _INSTRUCTIONS))
    return tasks.select("pos", "task_type", "instruction")


# Planner replies: a list in prose, a bare list, an object, prose only, and odd elements.
_PLANS = """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey,
       CASE c_custkey % 6
         WHEN 0 THEN 'Here is the plan:\n[{{"task_id": "' || c_name || '", "city": "' || c_mktsegment ||
                     '", "search_terms": ["a", "b"]}}, {{"task_type": "review", "state": "TX"}}]\nDone.'
         WHEN 1 THEN '[{{"task_id": null, "task_type": null, "city": "' || c_name || '"}}]'
         WHEN 2 THEN '{{"task_id": "' || c_name || '"}}'
         WHEN 3 THEN 'No plan today.'
         WHEN 4 THEN '[5, {{"industry": "' || c_mktsegment || '", "data_fields": []}}, "x"]'
         ELSE 'null' END AS reply
FROM {customer}
"""
_PLAN_ITEMS = f"""
WITH plans AS ({plain(_PLANS)}),
lists AS (SELECT c_custkey, c_custkey % 6 AS kind,
    CASE WHEN json_valid(reply) THEN reply
         WHEN strpos(reply, '[') > 0
         THEN substr(reply, strpos(reply, '['), length(reply) - strpos(reply, '[') - 5)
         ELSE '[]' END AS p FROM plans),
items AS (SELECT c_custkey, unnest(json_extract(p, '$[*]')) AS e,
    generate_subscripts(json_extract(p, '$[*]'), 1) - 1 AS pos
  FROM lists WHERE json_type(p) = 'ARRAY')
"""


def _text_sql(name: str, default: str) -> str:
    return (
        f"CASE WHEN json_exists(e, '$.{name}') THEN json_extract_string(e, '$.{name}') "
        f"ELSE {default} END AS {name}"
    )


@BOOK.query(f"""{_PLAN_ITEMS}
SELECT c_custkey, CAST(pos AS INTEGER) AS pos, {_text_sql('task_id', "'task_' || CAST(pos AS STRING)")},
       {_text_sql('task_type', "'city_search'")}, {_text_sql('city', 'NULL')},
       {_text_sql('state', 'NULL')}, {_text_sql('industry', 'NULL')},
       CAST(json_array_length(e, '$.search_terms') AS BIGINT) AS terms,
       CAST(json_array_length(e, '$.data_fields') AS BIGINT) AS fields
FROM items WHERE json_type(e) = 'OBJECT'""")
def planned_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, _ = tasks_from_replies(derive(spark, sf_dir, _PLANS), "reply")
    return tasks.select(
        "c_custkey", "pos", "task_id", "task_type", "city", "state", "industry",
        F.array_size("search_terms").cast("bigint").alias("terms"),
        F.array_size("data_fields").cast("bigint").alias("fields"),
    )


@BOOK.query(f"""{_PLAN_ITEMS}
SELECT c_custkey, CAST(pos AS INTEGER) AS pos, 'task is not an object' AS problem
FROM items WHERE json_type(e) <> 'OBJECT'
UNION ALL SELECT c_custkey, NULL, 'plan is not a list' FROM lists WHERE json_type(p) <> 'ARRAY'""")
def rejected_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks_from_replies(derive(spark, sf_dir, _PLANS), "reply")[1]
