"""From requests to a directory: plan, run, keep, extract, aggregate."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.fixed_values import STATES
from placebook.operators.enrich import run_kept
from placebook.operators.planning import (
    accepted_requests,
    full_prompt,
    plan_tasks,
    planner_prompt,
    rejected_requests,
    task_key,
    tasks_from_replies,
    uncovered_states,
    unplanned,
    with_instructions,
    with_prompts,
)
from placebook.operators.rollup import failed_tasks, run_stats, run_summary
from placebook.plans.directory import Directory, directory_of
from placebook.sinks.replies import read_reply_documents, read_unusable_replies, save_replies
from placebook.sources.targets import with_target_defaults


class Research(NamedTuple):
    """``rejected``: (target_id, state, reason) of all that was asked for and gave no task.
    ``unusable``: (task_key, task_id, problem) of the replies that hold no payload."""

    results: DataFrame
    failed: DataFrame
    summary: DataFrame
    directory: Directory | None
    rejected: DataFrame
    unusable: DataFrame


def _city_plan(requests: DataFrame, cities: DataFrame | None, required_only: bool) -> tuple[DataFrame, DataFrame]:
    codes = accepted_requests(requests)
    rejected = rejected_requests(requests).unionByName(uncovered_states(codes, cities))
    return plan_tasks(codes, cities, required_only), rejected


def _asked_plan(
    requests: DataFrame, work: Callable[[dict], str], concurrency: int, path: str, attempts: int
) -> tuple[DataFrame, DataFrame]:
    """Tasks that the planner names, each with its request's terms and fields unless it has its own."""
    # One bad code refuses its request, here as well.
    good = accepted_requests(requests).select("target_id").distinct()
    wanted = planner_prompt(requests.join(good, "target_id", "left_semi")).withColumns(
        {
            "task_id": F.concat(F.lit("plan_"), "target_id"),
            "task_key": task_key(F.lit("plan"), F.col("target_id")),
            "task_type": F.lit("planning"),
        }
    )
    answers = run_kept(wanted, work, concurrency, f"{path}/plans", attempts)
    given = ["industry", "search_terms", "data_fields"]
    own = wanted.select("task_key", "target_id", *[F.col(c).alias(f"asked_{c}") for c in given])
    answered = answers.join(own, "task_key")
    replies = answered.where("success").select("target_id", *[f"asked_{c}" for c in given], "output")
    tasks, unusable = tasks_from_replies(replies, "output")
    filled = {c: F.coalesce(c, f"asked_{c}") for c in given}
    key = {"task_key": task_key(F.col("target_id"), F.col("pos"), F.col("task_id"))}
    nowhere = F.lit(None).cast("string").alias("state")
    failed = answered.where("not success").select("target_id", nowhere, F.concat(F.lit("no plan: "), "error").alias("reason"))
    rejected = rejected_requests(requests).unionByName(failed).unionByName(
        unusable.select("target_id", nowhere, F.col("problem").alias("reason"))
    )
    return tasks.withColumns(filled | key).drop(*[f"asked_{c}" for c in given]), rejected


def _account(requests: DataFrame, tasks: DataFrame, rejected: DataFrame, path: str) -> None:
    """Keep the reasons known from planning, and with them what has neither a task nor a reason."""
    rejected.write.mode("overwrite").parquet(f"{path}/told")
    told = requests.sparkSession.read.parquet(f"{path}/told")
    unplanned(accepted_requests(requests), tasks, told).write.mode("overwrite").parquet(f"{path}/unplanned")


def run_research(
    requests: DataFrame,
    instructions: DataFrame,
    work: Callable[[dict], str],
    output_path: str,
    run_id: str,
    concurrency: int = 10,
    cities: DataFrame | None = None,
    skip_aggregation: bool = False,
    prefer: str = "array",
    required_only: bool = False,
    ask_planner: bool = False,
    attempts: int = 1,
    **options,
) -> Research:
    """Run the requests, ``TARGET_SCHEMA`` rows, and build the directory of their replies.

    Tasks are one per accepted state and city; with ``ask_planner``, ``work`` is first given a
    planning prompt per request and its replies name the tasks, of any type. Requests that name
    an unknown state are refused as a whole, states without a city give no task, and a plan may
    leave a request or a state out; all of these are in ``rejected``, so every request has a task or
    a reason. Every task has a key of its own, so targets may ask for the same city.
    Plans, tasks and results are kept as tables; the same call goes on with a run that was broken
    off and asks for nothing twice. Failed tasks are asked again up to ``attempts`` times, also by a
    later call with more attempts. The directory holds this run's replies, and its ``rejected`` those
    without a payload; ``options`` go to ``directory_of``.
    """
    spark = requests.sparkSession
    requests = with_target_defaults(requests)
    twice = requests.groupBy("target_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"targets given twice: {[row.target_id for row in twice]}")
    run_path = f"{output_path}/run={run_id}"
    if ask_planner:
        tasks, rejected = _asked_plan(requests, work, concurrency, run_path, attempts)
    else:
        tasks, rejected = _city_plan(requests, cities, required_only)
    tasks = with_instructions(with_prompts(tasks), instructions)
    tasks = tasks.withColumn(
        "prompt", full_prompt(F.col("prompt"), F.col("instruction"), web=True)
    )
    tasks.drop("spec").write.mode("overwrite").parquet(f"{run_path}/tasks")
    tasks = spark.read.parquet(f"{run_path}/tasks")
    _account(requests, tasks, rejected, f"{run_path}/rejected")
    results = run_kept(tasks, work, concurrency, f"{run_path}/results", attempts)
    save_replies(results, f"{output_path}/replies", run_id, prefer)

    built = None
    if not skip_aggregation:
        documents = read_reply_documents(spark, f"{output_path}/replies", run_id)
        built = directory_of(documents, f"{run_path}/aggregated", **options)
    # Only states with a task count as researched. A planner may name places that are no states; the
    # 51 codes bound the list.
    is_state = F.col("state").isin([code for code, _ in STATES])
    planned = tasks.agg(
        F.array_sort(F.collect_set(F.when(is_state, F.col("state")))).alias("states_researched"),
        F.count("*").alias("tasks_generated"),
    )
    summary = run_summary(run_stats(results), planned, built.summary if built else None)
    written = F.array(*[F.lit(path) for path in built.output_files]) if built else F.lit(None)
    summary = summary.withColumn("output_files", written.cast("array<string>"))
    rejected = spark.read.parquet(f"{run_path}/rejected/*")
    unusable = read_unusable_replies(spark, f"{output_path}/replies", run_id)
    return Research(results, failed_tasks(results), summary, built, rejected, unusable)
