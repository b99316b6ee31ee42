"""What to search for: industries with their search terms and wanted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.fixed_values import DEFAULT_DATA_FIELDS, DEFAULT_INDUSTRY, TERM_PATTERNS
from placebook.functions.templates import fill

TARGET_SCHEMA = (
    "target_id string, states string, industry string, "
    "search_terms array<string>, data_fields array<string>"
)


def default_fields() -> Column:
    return F.array(*[F.lit(name) for name in DEFAULT_DATA_FIELDS])


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Target definitions kept as JSON, one object per line."""
    return spark.read.schema(TARGET_SCHEMA).json(path)


def with_target_defaults(targets: DataFrame) -> DataFrame:
    """Fill in a missing industry, missing search terms and missing data fields."""
    industry = F.coalesce("industry", F.lit(DEFAULT_INDUSTRY))
    return targets.withColumn("industry", industry).withColumns(
        {
            "search_terms": F.coalesce("search_terms", F.array("industry")),
            "data_fields": F.coalesce("data_fields", default_fields()),
        }
    )


def scaffold_targets(industries: DataFrame) -> DataFrame:
    """A target definition for each ``industry``, with terms made from its name."""
    name = F.lower("industry")
    terms = F.array(*[fill(pattern, industry=name) for pattern in TERM_PATTERNS])
    return industries.withColumns({"search_terms": terms, "data_fields": default_fields()})
