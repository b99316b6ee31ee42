"""Counts by state, run statistics and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.sources.documents import NO_PAYLOAD, UNREADABLE


def by_state(listings: DataFrame) -> DataFrame:
    """Cities and businesses per state; listings without a state count as ``Unknown``.

    Counting per city first spreads a state with most of the rows over many groups, and what
    is left per state is one row per city.
    """
    state = F.coalesce(F.nullif(F.col("state"), F.lit("")), F.lit("Unknown"))
    per_city = listings.groupBy(state.alias("state"), "city").agg(F.count("*").alias("n"))
    return (
        per_city.groupBy("state")
        .agg(
            F.count_if(F.coalesce(F.col("city"), F.lit("")) != "").alias("cities"),
            F.sum("n").alias("businesses"),
        )
        .orderBy("state")
    )


def run_stats(results: DataFrame) -> DataFrame:
    """One row of statistics over task results; zeros when there are none."""
    total = F.count("*")
    good = F.count_if("success")
    spent = F.coalesce(F.sum("execution_time"), F.lit(0.0))
    return results.agg(
        total.alias("total_tasks"),
        good.alias("successful"),
        (total - good).alias("failed"),
        F.when(total > 0, good / total * 100).otherwise(0.0).alias("success_rate"),
        spent.alias("total_time"),
        F.when(total > 0, spent / total).otherwise(0.0).alias("average_time"),
    )


def failed_tasks(results: DataFrame) -> DataFrame:
    """Ids of the tasks that failed."""
    return results.where(~F.col("success")).select("task_id")


def readable_files() -> Column:
    """Number of documents with a value, as an aggregate over normalised rows.

    One row is marked per document, so files are counted without a distinct. A document whose text
    was JSON counts even if its content could not be used; a reply without a payload is no document.
    """
    unreadable = F.col("problem").isin(*UNREADABLE, NO_PAYLOAD)
    return F.count_if(F.col("first") & ~F.coalesce(unreadable, F.lit(False)))


def one_row(spark: SparkSession, numbers: dict[str, int]) -> DataFrame:
    """Numbers that are known already, as a table."""
    return spark.range(1).select(*[F.lit(n).cast("bigint").alias(name) for name, n in numbers.items()])


def run_summary(stats: DataFrame, planned: DataFrame, aggregation: DataFrame | None) -> DataFrame:
    """One row for a whole run.

    ``planned`` holds ``states_researched`` and ``tasks_generated``. Without ``aggregation``
    that block is null.
    """
    executed = stats.select(
        F.col("total_tasks").alias("tasks_executed"),
        F.col("successful").alias("tasks_successful"),
        F.col("failed").alias("tasks_failed"),
        F.col("total_time").alias("execution_time"),
    )
    summary = side_by_side(planned, executed)
    if aggregation is None:
        empty = "struct<input_files:bigint,total_records_found:bigint,unique_records:bigint,"
        empty += "duplicates_removed:bigint>"
        return summary.withColumn("aggregation", F.lit(None).cast(empty))
    block = aggregation.select(F.struct(*aggregation.columns).alias("aggregation"))
    return side_by_side(summary, block)


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two one-row results with different columns into one row."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in both.columns])
