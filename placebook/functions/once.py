"""Evaluate an expensive expression once per row, however often it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is evaluated once.

    Written out, the value would be repeated in the expression at every use, and nested uses
    would multiply.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def once(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Select columns that later filters and projections read instead of computing again.

    A filter on a plain computed column is pushed below its projection and repeats the
    expression there. It cannot be pushed below a generator, which here yields one row per row.
    """
    return df.select(_row(columns))


def with_once(df: DataFrame, **columns: Column | str) -> DataFrame:
    """``df`` with columns added as in ``once``."""
    return df.select("*", _row(columns))


def _row(columns: dict[str, Column | str]) -> Column:
    named = [
        (F.expr(value) if isinstance(value, str) else value).alias(name)
        for name, value in columns.items()
    ]
    return F.inline(F.array(F.struct(*named)))
