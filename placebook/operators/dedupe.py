"""Keep the most complete listing of every business."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebook.functions.contacts import listing_key
from placebook.functions.truth import completeness

# Columns this module adds to a listing.
KEY, FIRST_SEEN, SIGHTINGS = "listing_key", "first_seen", "sightings"


def with_key(df: DataFrame, mode: str = "substring") -> DataFrame:
    key = listing_key(F.col("company_name"), F.col("city"), F.col("state"), mode)
    return df.withColumn(KEY, key)


def with_completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """Add ``filled``, the number of present values among ``fields``."""
    return df.withColumn("filled", F.expr(completeness(df, fields)))


def _best(df: DataFrame, seen: Column, extra_aggs: list[Column]) -> DataFrame:
    """One row per key by a total order: more filled first, then seen earlier.

    A plain aggregate, so every task first reduces its own rows to one per key. A key with a
    third of all rows then sends one row per task through the shuffle. Rows are sorted for it by a
    hash before the key: names share their first letters, and hashes are told apart at a glance.
    """
    payload = [c for c in df.columns if c not in (KEY, FIRST_SEEN, SIGHTINGS)]
    best = F.min_by(F.struct(*payload), F.struct(-F.col("filled"), seen)).alias("best")
    grouped = df.groupBy(F.xxhash64(KEY), KEY).agg(best, *extra_aggs)
    return grouped.select(*[F.col("best")[c].alias(c) for c in payload], KEY, FIRST_SEEN, SIGHTINGS)


def dedupe(df: DataFrame, order: list[str], mode: str = "substring") -> DataFrame:
    """The most complete listing per key; of equals the one seen first.

    ``order`` names the columns that say when a row was seen; together they must be unique.
    ``first_seen`` is where the key was seen first, even if a later row won, and gives the
    output position. ``sightings`` counts the rows of the key.
    """
    seen = F.struct(*order)
    return _best(
        with_key(df, mode), seen, [F.min(seen).alias(FIRST_SEEN), F.count("*").alias(SIGHTINGS)]
    )


def merge_winners(winners: DataFrame, order: list[str]) -> DataFrame:
    """Dedupe the results of several ``dedupe`` calls over disjoint rows.

    Equal to one ``dedupe`` over all rows, since the order is total.
    """
    return _best(
        winners,
        F.struct(*order),
        [F.min(FIRST_SEEN).alias(FIRST_SEEN), F.sum(SIGHTINGS).alias(SIGHTINGS)],
    )


def duplicate_numbers() -> list[Column]:
    """Records found, unique records and duplicates removed, as aggregates over winners."""
    total = F.coalesce(F.sum(SIGHTINGS), F.lit(0)).cast("bigint")
    return [
        total.alias("total_records_found"),
        F.count("*").alias("unique_records"),
        (total - F.count("*")).alias("duplicates_removed"),
    ]


def duplicate_counts(winners: DataFrame) -> DataFrame:
    """One row of ``duplicate_numbers``."""
    return winners.agg(*duplicate_numbers())
