"""From targets and states to tasks with their prompts.

Lookups of states and built-in cities are broadcast, as their size is fixed by the package.
Tables given by the caller are joined without a hint, so Spark decides by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placebook.fixed_values import (
    CITY_SEARCH,
    CITY_SEARCH_PROMPT,
    COMPANY_RESEARCH,
    COMPANY_RESEARCH_PROMPT,
    INSTRUCTION_DIVIDER,
    MAJOR_CITIES,
    MINIMUM_CITIES,
    PLANNER_PROMPT,
    SEARCH_PATTERNS,
    STATES,
    WEB_MARK,
)
from placebook.functions.contacts import joined, search_task_id, strip
from placebook.functions.once import with_once
from placebook.functions.payload import plan_json
from placebook.functions.templates import fill, json_object
from placebook.operators.normalise import member, text_or
from placebook.session import prepare

TASK_FIELDS = {
    "task_id": T.StringType(),
    "task_type": T.StringType(),
    "company_name": T.StringType(),
    "city": T.StringType(),
    "state": T.StringType(),
    "industry": T.StringType(),
    "search_terms": T.ArrayType(T.StringType()),
    "data_fields": T.ArrayType(T.StringType()),
}


def _lookup(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A fixed table as literals, so that its size is known to the planner."""
    # Texts of these tables hold no quotes; numbers and truth values read the same in SQL.
    spelled = ", ".join(str(tuple(row)) for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {spelled} AS t({', '.join(names)})")


def states(spark: SparkSession) -> DataFrame:
    """``(code, name)`` of the states."""
    return _lookup(spark, STATES, ["code", "name"])


def major_cities(spark: SparkSession) -> DataFrame:
    """``(state, city, city_rank, required)`` of the built-in cities, ranks from 1."""
    rows = [
        (state, city, rank, rank <= MINIMUM_CITIES[state])
        for state, cities in MAJOR_CITIES.items()
        for rank, city in enumerate(cities, 1)
    ]
    return _lookup(spark, rows, ["state", "city", "city_rank", "required"])


def parse_states(requests: DataFrame, column: str = "states") -> DataFrame:
    """One row per state code of a comma-separated list, in order of ``state_pos``.

    A null list is one row with a null code.
    """
    codes = F.posexplode_outer(F.split(column, ",")).alias("state_pos", "code")
    return requests.select("*", codes).select(
        *requests.columns, "state_pos", F.upper(strip(F.col("code"))).alias("state")
    )


def validate_states(codes: DataFrame, column: str = "state") -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)`` rows; null codes are rejected."""
    known = F.broadcast(states(codes.sparkSession).select(F.col("code").alias(column)))
    return codes.join(known, column, "left_semi"), codes.join(known, column, "left_anti")


def _unknown(column: str) -> Column:
    """Codes of a request's list that are no state; null for a null list."""
    codes = F.transform(F.split(column, ","), lambda code: F.upper(strip(code)))
    return F.filter(codes, lambda code: ~code.isin([code for code, _ in STATES]))


def accepted_requests(requests: DataFrame, column: str = "states") -> DataFrame:
    """One row per state of the requests without any bad code; one bad code refuses its request.

    A request is judged on its own row, so nothing is joined or shuffled.
    """
    return parse_states(requests.where(F.size(_unknown(column)) == 0), column)


def rejected_requests(requests: DataFrame, key: str = "target_id", column: str = "states") -> DataFrame:
    """``(key, state, reason)`` for every bad code, and for requests without a list."""
    judged = requests.select(key, F.explode_outer(_unknown(column)).alias("state"), F.col(column).isNull().alias("no_list"))
    reason = F.when(F.col("no_list"), "no states given").otherwise("unknown state")
    return judged.where("no_list or state is not null").select(key, "state", reason.alias("reason"))


def uncovered_states(codes: DataFrame, cities: DataFrame | None = None, key: str = "target_id") -> DataFrame:
    """``(key, state, reason)`` for states that have no city, built-in or given: they get no task."""
    known = major_cities(codes.sparkSession) if cities is None else cities
    missing = codes.join(known.select("state").distinct(), "state", "left_anti")
    return missing.select(key, "state", F.lit("no cities known").alias("reason"))


def unplanned(codes: DataFrame, tasks: DataFrame, told: DataFrame, key: str = "target_id") -> DataFrame:
    """``(key, state, reason)`` for accepted requests and states that got no task and no reason yet.

    ``codes`` has one row per accepted request and state, ``tasks`` are the planned ones, ``told`` the
    rejections known so far. A request without any task is one row with a null state. A task without
    a state may serve all states of its request; tasks name states in any letter case.
    """
    code = F.upper(strip(F.col("state")))
    planned = tasks.groupBy(key, code.alias("state")).agg(F.lit(1).alias("has_task"))
    whole = planned.groupBy(key).agg(F.max(F.coalesce("state", F.lit("")) == "").alias("any_state"))
    asked = codes.select(key, "state").distinct()
    silent = asked.select(key).distinct().join(told.select(key).distinct(), key, "left_anti")
    silent = silent.join(whole.select(key), key, "left_anti")
    by_state = asked.join(whole.where(~F.col("any_state")).select(key), key, "left_semi")
    by_state = by_state.join(planned.select(key, "state"), [key, "state"], "left_anti")
    by_state = by_state.join(told.select(key, "state"), [key, "state"], "left_anti")
    nowhere = F.lit(None).cast("string").alias("state")
    return silent.select(key, nowhere, F.lit("no task in plan").alias("reason")).unionByName(
        by_state.select(key, "state", F.lit("no task for this state").alias("reason"))
    )


def with_state_name(df: DataFrame, column: str = "state") -> DataFrame:
    """Add ``state_name``; null for unknown codes."""
    names = states(df.sparkSession).select(
        F.col("code").alias(column), F.col("name").alias("state_name")
    )
    return df.join(F.broadcast(names), column, "left")


def with_major_cities(df: DataFrame, column: str = "state", required: bool = False) -> DataFrame:
    """One row per built-in city of the state, in any letter case; none for other states.

    ``required`` keeps the cities a plan must cover at least.
    """
    cities = major_cities(df.sparkSession)
    if required:
        cities = cities.where("required")
    cities = cities.select(F.col("state").alias("city_state"), "city", "city_rank")
    return df.join(
        F.broadcast(cities), F.upper(df[column]) == F.col("city_state"), "inner"
    ).drop("city_state")


def plan_tasks(
    requests: DataFrame, cities: DataFrame | None = None, required_only: bool = False, key: str = "target_id"
) -> DataFrame:
    """One city task per requested state and city, with all terms and fields of its target.

    ``requests`` has one row per target and ``state``. Without ``cities``, ``(state, city)``, all
    built-in cities are used; ``required_only`` keeps to those a plan must cover at least.
    ``task_id`` names state and city only, so targets share it; ``task_key`` is unique.
    """
    if cities is None:
        located = with_major_cities(requests, required=required_only).drop("city_rank")
    else:
        located = requests.join(cities.select("state", "city").distinct(), "state")
    place = F.col("state_pos") if "state_pos" in requests.columns else F.lit(0)
    return located.withColumns(
        {
            "task_id": search_task_id(F.col("state"), F.col("city")),
            "task_type": F.lit(CITY_SEARCH),
            "task_key": task_key(F.col(key), place, F.col("state"), F.col("city")),
        }
    )


def task_key(*parts: Column) -> Column:
    """A key that differs if any part differs; parts may hold any text or be null."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    return F.concat_ws("~", *[F.replace(F.replace(t, F.lit("%"), F.lit("%25")), F.lit("~"), F.lit("%7E")) for t in texts])


def expand_queries(tasks: DataFrame) -> DataFrame:
    """Add ``query``: every search phrase for every search term of a task."""
    by_term = tasks.withColumn("search_term", F.explode("search_terms"))
    values = {name: F.col(name) for name in ("search_term", "city", "state")}
    phrases = F.array(*[fill(pattern, **values) for pattern in SEARCH_PATTERNS])
    return by_term.withColumn("query", F.explode(phrases))


def with_task_defaults(tasks: DataFrame, position: str) -> DataFrame:
    """Fill in a missing type, and a missing id from the task's place in its list."""
    return tasks.withColumns(
        {
            "task_type": F.coalesce("task_type", F.lit(CITY_SEARCH)),
            "task_id": F.coalesce(
                "task_id", F.concat(F.lit("task_"), F.col(position).cast("string"))
            ),
        }
    )


def tasks_from_replies(replies: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """``(tasks, rejected)`` from planner reply texts.

    Each list element is one task, ``pos`` its place, ``spec`` the element itself. Absent
    type and id get their defaults; a type that is there but null stays null. Replies that
    are no list, and elements that are no object, are rejected.
    """
    prepare(replies.sparkSession)
    kept = [c for c in replies.columns if c != text]
    plan = F.try_variant_get(plan_json(text), "$", "array<variant>")
    items = with_once(replies, items=plan).select(*kept, "items")
    bad_replies = items.where("items IS NULL").select(
        *kept, F.lit(None).cast("int").alias("pos"), F.lit("plan is not a list").alias("problem")
    )
    specs = items.select(*kept, F.posexplode("items").alias("pos", "spec"))
    is_object = F.schema_of_variant("spec").startswith("OBJECT")
    bad_items = specs.where(~is_object).select(
        *kept, "pos", F.lit("task is not an object").alias("problem")
    )
    fields = {
        name: f"try_variant_get(spec, '$.{name}', '{kind.simpleString()}')"
        for name, kind in TASK_FIELDS.items()
    }
    fields["task_id"] = text_or(member("spec", "task_id"), "concat('task_', pos)")
    fields["task_type"] = text_or(member("spec", "task_type"), f"'{CITY_SEARCH}'")
    tasks = specs.where(is_object).selectExpr(
        *kept, "pos", "spec", *[f"{value} AS {name}" for name, value in fields.items()]
    )
    return tasks, bad_replies.unionByName(bad_items)


def _prompt(tasks: DataFrame) -> Column:
    """Prompt by task type; a task of another type is given as JSON."""

    def value(name: str) -> Column:
        if name not in tasks.columns:
            return F.lit("")
        return joined(F.col(name)) if name in ("search_terms", "data_fields") else F.col(name)

    values = {name: value(name) for name in TASK_FIELDS}
    if "spec" in tasks.columns:
        as_json = F.to_json("spec")
    else:
        named = [name for name in TASK_FIELDS if name in tasks.columns]
        as_json = json_object({name: (F.col(name), TASK_FIELDS[name]) for name in named})
    return (
        F.when(F.col("task_type") == CITY_SEARCH, fill(CITY_SEARCH_PROMPT, **values))
        .when(F.col("task_type") == COMPANY_RESEARCH, fill(COMPANY_RESEARCH_PROMPT, **values))
        .otherwise(as_json)
    )


def with_prompts(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("prompt", _prompt(tasks))


def with_instructions(tasks: DataFrame, instructions: DataFrame) -> DataFrame:
    """Add ``instruction`` by task type, else that of a city search, else an empty text.

    ``instructions``, ``(task_type, text)``, is joined as given: any type may have one text. A type
    with several texts is refused, as nothing says which of them holds.
    """
    twice = instructions.groupBy("task_type").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"several instructions for {sorted(str(row.task_type) for row in twice)}")
    own = instructions.select("task_type", F.col("text").alias("own_text"))
    # One row, with or without a text: no task has to meet others of its kind for it.
    fallback = instructions.agg(F.max(F.when(F.col("task_type") == CITY_SEARCH, F.col("text"))).alias("fallback_text"))
    return (
        tasks.join(own, "task_type", "left")
        .join(F.broadcast(fallback))
        .withColumn("instruction", F.coalesce("own_text", "fallback_text", F.lit("")))
        .drop("own_text", "fallback_text")
    )


def full_prompt(prompt: Column, instruction: Column, web: bool = False) -> Column:
    """Instruction, divider and prompt; the prompt alone without an instruction.

    The web mark goes in front of the prompt, hence behind the instruction.
    """
    marked = F.concat(F.lit(WEB_MARK), prompt) if web else prompt
    with_instruction = F.concat(instruction, F.lit(INSTRUCTION_DIVIDER), marked)
    return F.when(F.length(instruction) > 0, with_instruction).otherwise(marked)


def planner_prompt(requests: DataFrame) -> DataFrame:
    """Add ``prompt`` for the planner; one row per target with its ``states`` list text."""
    codes = F.transform(F.split("states", ","), lambda code: F.upper(strip(code)))
    prompt = fill(
        PLANNER_PROMPT,
        industry=F.col("industry"),
        states=joined(codes),
        search_terms=joined(F.col("search_terms")),
        data_fields=joined(F.col("data_fields")),
    )
    return requests.withColumn("prompt", prompt)
