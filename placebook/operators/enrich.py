"""Run every task through an outside function, in parallel and without failing the run.

Calls to an outside function are slow and cost money, so nothing is asked twice by accident. Tasks
are kept as a table of files, each a slice of the keys. The table is read as a stream,
slice by slice, and every slice's results are committed alone: a run that is broken off loses the
slice it was in, and the same call goes on behind the last committed one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.session import count_files, has_files
from placebook.sources.documents import tag_replies

RESULT_SCHEMA = (
    "task_key string, task_id string, success boolean, output string, error string, execution_time double"
)
#: Outcomes handed on at a time; a lost task repeats no more than it has to.
_AT_ONCE = 16
#: Slices of a run at the most, unless the caller says how large they are: each costs a commit of its own.
MOST_SLICES = 64


def keyed(tasks: DataFrame) -> DataFrame:
    """Tasks with a ``task_key``; without one of its own a task is known by its id."""
    return tasks if "task_key" in tasks.columns else tasks.withColumn("task_key", F.col("task_id"))


def run_tasks(tasks: DataFrame, work: Callable[[dict], str], concurrency: int) -> DataFrame:
    """``RESULT_SCHEMA`` rows, one per task.

    ``work`` gets the columns of one task, with the types Arrow gives them, and returns the
    reply text. What it raises becomes the error of that task. At most ``concurrency`` tasks
    run at a time, each in its own partition; tasks are spread by the hash of their key.

    The result is lazy and every use runs the tasks again: write it to a table first, see
    ``save_results`` and ``run_kept``.
    """

    def attempt(task: dict) -> dict:
        began = time.monotonic()
        try:
            output, error = work(task), None
        except Exception as failure:  # noqa: BLE001 - any failure belongs to its task
            output, error = None, str(failure) or type(failure).__name__
        return {
            "task_key": task["task_key"],
            "task_id": task["task_id"],
            "success": error is None,
            "output": output,
            "error": error,
            "execution_time": time.monotonic() - began,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.field(name, pa.string()) for name in ("task_key", "task_id", "output", "error")]
        schema = pa.schema([*fields[:2], pa.field("success", pa.bool_()), *fields[2:], pa.field("execution_time", pa.float64())])
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                done = [attempt(task) for task in batch.slice(at, _AT_ONCE).to_pylist()]
                yield pa.RecordBatch.from_pylist(done, schema=schema)

    return keyed(tasks).repartition(concurrency, "task_key").mapInArrow(run, RESULT_SCHEMA)


def save_results(results: DataFrame, path: str) -> DataFrame:
    """Run the tasks once, keep their results, and return the kept table."""
    results.write.mode("errorifexists").parquet(path)
    return results.sparkSession.read.parquet(path)


KEPT_SCHEMA = f"{RESULT_SCHEMA}, attempt int"


def check_keys(tasks: DataFrame) -> None:
    """Refuse tasks without a key and tasks that share one: a result belongs to one task."""
    odd = tasks.groupBy("task_key").count().where("count > 1 OR task_key IS NULL").limit(5).collect()
    if odd:
        raise ValueError(f"tasks without a key of their own: {sorted(str(row.task_key) for row in odd)}")


def run_kept(
    tasks: DataFrame,
    work: Callable[[dict], str],
    concurrency: int,
    path: str,
    attempts: int = 1,
    slice_rows: int | None = None,
) -> DataFrame:
    """Run every task and keep the results below ``path``; one ``KEPT_SCHEMA`` row per task.

    The first call decides which tasks there are; later calls with the same ``path`` go on with
    them. Tasks that failed are asked again until ``attempts`` attempts are made; ``work`` finds the
    number in the task's ``attempt``. Calling again with more attempts asks for the failed ones only,
    and their results of every attempt stay.
    ``slice_rows`` tasks are committed at a time, by default 64 for each that runs at a time, or more where
    that would be over ``MOST_SLICES`` slices: a broken run then repeats a 64th of its tasks at the most.
    """
    spark = tasks.sparkSession
    for attempt in range(1, attempts + 1):
        part = f"{path}/attempt={attempt}"
        if not has_files(spark, f"{part}/tasks/_SUCCESS"):
            if attempt == 1:
                asked = keyed(tasks)
                check_keys(asked)
            else:
                failed = kept_results(spark, path, attempt - 1).where(~F.col("success")).select("task_key")
                first = spark.read.parquet(f"{path}/attempt=1/tasks")
                asked = first.join(failed, "task_key", "left_semi")
            asked.repartition(_slices(asked.count(), concurrency, slice_rows), "task_key").write.mode("overwrite").parquet(f"{part}/tasks")
        _run_slices(spark, part, work, concurrency, attempt, slice_rows)
    return kept_results(spark, path, attempts)


def _slices(count: int, concurrency: int, slice_rows: int | None) -> int:
    """Into how many slices so many tasks are cut."""
    slice_rows = slice_rows or max(2_000, 64 * concurrency, -(-count // MOST_SLICES))
    return max(1, -(-count // slice_rows))


def _run_slices(
    spark: SparkSession, part: str, work: Callable[[dict], str], concurrency: int, attempt: int, slice_rows: int | None
) -> None:
    tasks = spark.read.parquet(f"{part}/tasks")
    # Spark may have written more files than were asked for; a slice is then several of them.
    wanted = _slices(tasks.count(), concurrency, slice_rows)
    files = -(-count_files(spark, f"{part}/tasks/part-*") // wanted)
    slices = spark.readStream.schema(tasks.schema).option("maxFilesPerTrigger", max(1, files)).parquet(f"{part}/tasks")

    def run(batch: DataFrame, batch_id: int) -> None:
        # A slice that comes again after a failure replaces what its first try left.
        asked = batch.withColumn("attempt", F.lit(attempt))
        results = run_tasks(asked, work, concurrency).withColumn("attempt", F.lit(attempt))
        results.write.mode("overwrite").parquet(f"{part}/results/slice={batch_id}")

    writer = slices.writeStream.foreachBatch(run).option("checkpointLocation", f"{part}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()


def kept_results(spark: SparkSession, path: str, attempts: int) -> DataFrame:
    """The last result of every task of a run with that many attempts."""
    parts = [f"{path}/attempt={n}/results/slice=*" for n in range(1, attempts + 1)]
    parts = [part for part in parts if has_files(spark, part)]
    if not parts:
        return spark.createDataFrame([], KEPT_SCHEMA)
    # A task has a later attempt if, and only if, an earlier one failed.
    results = spark.read.schema(KEPT_SCHEMA).parquet(*parts)
    return results.where(F.col("success") | (F.col("attempt") == attempts))


def with_payload(results: DataFrame, prefer: str = "array") -> DataFrame:
    """Successful results with their ``payload`` and, where there is none, the ``problem``."""
    return tag_replies(results.where("success"), "output", prefer)
