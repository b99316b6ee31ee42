import json

import pytest
from pyspark.sql import functions as F

from placebook.fixed_values import DEFAULT_DATA_FIELDS
from placebook.operators.planning import (
    accepted_requests,
    expand_queries,
    full_prompt,
    major_cities,
    parse_states,
    plan_tasks,
    planner_prompt,
    rejected_requests,
    states,
    task_key,
    tasks_from_replies,
    uncovered_states,
    validate_states,
    with_instructions,
    with_major_cities,
    with_prompts,
    with_state_name,
    with_task_defaults,
)
from placebook.sources.targets import TARGET_SCHEMA, read_targets, scaffold_targets, with_target_defaults


@pytest.fixture
def requests(spark):
    rows = [
        ("ems", " tx,ca ", "EMS", ["ambulance", "medical transport"], None),
        ("plumbing", "NY, zz,TX", None, None, ["company_name"]),
    ]
    return with_target_defaults(spark.createDataFrame(rows, TARGET_SCHEMA))


def test_fixed_tables(spark):
    assert states(spark).count() == 51
    cities = major_cities(spark)
    assert (cities.count(), cities.where("required").count()) == (66, 53)
    per_state = {r.state: r.n for r in cities.groupBy("state").agg(F.max("city_rank").alias("n")).collect()}
    assert per_state == {"TX": 8, "CA": 8, "FL": 8} | dict.fromkeys(["NY", "IL", "PA", "OH", "GA", "NC", "MI"], 6)


def test_target_defaults(requests):
    row = requests.where("target_id = 'plumbing'").first()
    assert (row.industry, row.search_terms, row.data_fields) == ("businesses", ["businesses"], ["company_name"])
    assert requests.first().data_fields == DEFAULT_DATA_FIELDS


def test_targets_from_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"target_id": "a", "industry": "EMS", "context": "unused"}))
    [row] = with_target_defaults(read_targets(spark, str(tmp_path))).collect()
    assert (row.industry, row.search_terms) == ("EMS", ["EMS"])


def test_scaffold(spark):
    [row] = scaffold_targets(spark.createDataFrame([("Plumbing",)], "industry string")).collect()
    assert row.search_terms == ["plumbing", "plumbing company", "plumbing services", "plumbing provider"]
    assert (row.industry, row.data_fields) == ("Plumbing", DEFAULT_DATA_FIELDS)


def test_states_are_parsed_and_checked(requests):
    codes = parse_states(requests)
    assert [(r.target_id, r.state) for r in codes.orderBy("target_id", "state_pos").collect()] == [
        ("ems", "TX"), ("ems", "CA"), ("plumbing", "NY"), ("plumbing", "ZZ"), ("plumbing", "TX"),
    ]
    valid, bad = validate_states(codes)
    assert (valid.count(), [r.state for r in bad.collect()]) == (4, ["ZZ"])
    assert {r.target_id for r in accepted_requests(requests).collect()} == {"ems"}
    assert [tuple(r) for r in rejected_requests(requests).collect()] == [("plumbing", "ZZ", "unknown state")]


def test_requests_without_states(spark):
    rows = [("none", None, None, None, None), ("blank", "", None, None, None), ("good", "wa,TX", None, None, None)]
    requests = spark.createDataFrame(rows, TARGET_SCHEMA)
    assert {r.target_id for r in parse_states(requests).collect()} == {"none", "blank", "good"}
    codes = accepted_requests(requests)
    assert sorted((r.target_id, r.state) for r in codes.collect()) == [("good", "TX"), ("good", "WA")]
    assert sorted(map(tuple, rejected_requests(requests).collect())) == [
        ("blank", "", "unknown state"), ("none", None, "no states given"),
    ]
    assert [tuple(r) for r in uncovered_states(codes).collect()] == [("good", "WA", "no cities known")]


def test_requests_are_judged_in_one_scan(spark, tmp_path):
    path = str(tmp_path / "requests")
    spark.createDataFrame([("a", "TX", None, None, None)], TARGET_SCHEMA).write.parquet(path)
    plan = plan_tasks(accepted_requests(spark.read.parquet(path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange hashpartitioning" not in plan


def test_lookups(spark):
    df = spark.createDataFrame([("tx",), ("DC",), ("zz",)], "state string")
    assert [r.state_name for r in with_state_name(df).orderBy("state").collect()] == ["District of Columbia", None, None]
    found = [r.city for r in with_major_cities(df).orderBy("city_rank").collect()]
    assert found[:2] == ["Houston", "Dallas"] and len(found) == 8


def test_tasks_and_queries(requests):
    codes = accepted_requests(requests)
    assert plan_tasks(codes, required_only=True).count() == 12
    tasks = plan_tasks(codes)
    assert tasks.count() == tasks.select("task_key").distinct().count() == 16
    worth = tasks.where("city = 'Fort Worth'")
    row = worth.first()
    assert (row.task_id, row.task_type, row.data_fields) == ("search_TX_FortWorth", "city_search", DEFAULT_DATA_FIELDS)
    assert sorted(r.query for r in expand_queries(worth).where("search_term = 'ambulance'").collect()) == [
        "Fort Worth TX ambulance companies", "ambulance in Fort Worth, TX",
        "ambulance near Fort Worth TX", "best ambulance Fort Worth TX",
    ]


def test_tasks_for_cities_of_the_caller(spark, requests):
    own = spark.createDataFrame([("CA", "Santa Ana"), ("AK", "Nome")], "state string, city string")
    tasks = plan_tasks(parse_states(requests), own)
    assert [r.task_id for r in tasks.collect()] == ["search_CA_SantaAna"]


def test_prompts(spark):
    rows = [
        (0, "t0", "city_search", None, "Waco", "TX", "EMS", ["a", "b"], ["phone"]),
        (1, None, "company_research", "Acme", "Waco", None, "EMS", None, None),
        (2, "t2", "review", 'A "q" é', None, None, None, ["x", "y"], []),
        (3, None, None, None, None, None, None, None, None),
    ]
    schema = (
        "pos int, task_id string, task_type string, company_name string, city string, state string, "
        "industry string, search_terms array<string>, data_fields array<string>"
    )
    tasks = with_task_defaults(spark.createDataFrame(rows, schema), "pos")
    city, company, other, bare = [r.prompt for r in with_prompts(tasks).orderBy("pos").collect()]
    assert city.startswith("\nSearch for businesses in:\nCity: Waco\nState: TX\nIndustry: EMS\n\n")
    assert "Search terms to use: a, b\nData fields to collect: phone\n\nTask ID: t0\n" in city
    assert "Company Name: Acme\nLocation: Waco, \nIndustry: EMS\n\nTask ID: task_1\n" in company
    assert other == json.dumps(
        {"task_id": "t2", "task_type": "review", "company_name": 'A "q" é', "search_terms": ["x", "y"], "data_fields": []}
    )
    assert "City: \nState: \n" in bare and "Task ID: task_3" in bare


def test_planner_prompt(requests):
    text = planner_prompt(requests).where("target_id = 'ems'").first().prompt
    assert "Industry: EMS\nStates to research: TX, CA\nSearch terms to use: ambulance, medical transport\n" in text


def test_instructions(spark):
    rows = [("city_search", "S"), ("company_research", ""), ("review", "R"), ("manager", "M")]
    table = spark.createDataFrame(rows, "task_type string, text string")
    tasks = spark.createDataFrame([("city_search",), ("company_research",), ("review",), (None,)], "task_type string")
    got = {r.task_type: r.instruction for r in with_instructions(tasks, table).collect()}
    assert got == {"city_search": "S", "company_research": "", "review": "R", None: "S"}
    none = with_instructions(tasks, table.where("task_type = 'manager'"))
    assert {r.instruction for r in none.collect()} == {""}


def test_full_prompt(column):
    assert column(["S", ""], lambda x: full_prompt(F.lit("p"), x)) == ["S\n\n---\n\np", "p"]
    assert column(["S", ""], lambda x: full_prompt(F.lit("p"), x, web=True)) == ["S\n\n---\n\n@web p", "@web p"]


def test_tasks_from_replies(spark):
    specs = [
        {"task_id": "t", "city": "Waco", "search_terms": ["a"], "state": 5},
        {"task_type": None, "task_id": None}, "no task", {"task_type": "review"},
    ]
    rows = [(0, "Plan:\n" + json.dumps(specs) + "\nDone"), (1, '{"a": 1}'), (2, "no plan"), (3, "null")]
    tasks, bad = tasks_from_replies(spark.createDataFrame(rows, "id int, reply string"), "reply")
    got = [(r.pos, r.task_id, r.task_type, r.city, r.search_terms, r.state) for r in tasks.orderBy("pos").collect()]
    assert got == [
        (0, "t", "city_search", "Waco", ["a"], "5"), (1, None, None, None, None, None),
        (3, "task_3", "review", None, None, None),
    ]
    assert sorted((r.id, r.pos or 0, r.problem) for r in bad.collect()) == [
        (0, 2, "task is not an object"), (1, 0, "plan is not a list"), (3, 0, "plan is not a list"),
    ]
    prompts = [r.prompt for r in with_prompts(tasks).orderBy("pos").collect()]
    assert json.loads(prompts[1]) == specs[1] and json.loads(prompts[2]) == specs[3]


def test_task_keys_differ_if_a_part_differs(spark):
    parts = [("a~b", "c"), ("a", "b~c"), ("a%7Eb", "c"), (None, "c"), ("", "c~")]
    rows = spark.createDataFrame(parts, "x string, y string").select(task_key(F.col("x"), F.col("y")).alias("k"))
    assert len({r.k for r in rows.collect()}) == 5


def test_a_type_has_one_instruction(spark):
    tasks = spark.createDataFrame([("review",)], "task_type string")
    texts = spark.createDataFrame([("review", "old"), ("review", "new")], "task_type string, text string")
    with pytest.raises(ValueError, match="review"):
        with_instructions(tasks, texts)
    assert with_instructions(tasks, texts.where("text = 'new'")).first().instruction == "new"
