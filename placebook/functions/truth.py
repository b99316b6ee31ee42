"""Which values count as present: null, empty, zero and false do not.

The functions take and give SQL expressions as text. They are used on many columns at a time,
and Spark reads one text much faster than it is told a tree of columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from placebook.functions.once import let


def present_scalar(value: str) -> str:
    """Truth of a variant that is neither a list nor an object."""
    by_kind = """CASE json_kind WHEN 'VOID' THEN false
        WHEN 'STRING' THEN variant_get(scalar, '$', 'string') <> ''
        WHEN 'BOOLEAN' THEN variant_get(scalar, '$', 'boolean')
        ELSE coalesce(try_variant_get(scalar, '$', 'double') <> 0, true) END"""
    return let("scalar", value, let("json_kind", "schema_of_variant(scalar)", by_kind))


def present_variant(value: str) -> str:
    """Truth of any variant; lists and objects count when they have a member."""

    def has_member(kind: str) -> str:
        members = f"try_variant_get({value}, '$', '{kind}')"
        return let("members", members, "CASE WHEN members IS NOT NULL THEN size(members) > 0 END")

    return f"""CASE WHEN {value} IS NULL THEN false ELSE coalesce(
        {has_member('array<variant>')}, {has_member('map<string,variant>')},
        {present_scalar(value)}) END"""


def present_field(value: str, text: str) -> str:
    """Truth of a small variant whose text form is already at hand.

    Almost every field is a string, so only texts that could stand for an absent value of
    another type look at the variant again.
    """
    doubtful = f"""{text} IN ('false', '[]', '{{}}') OR startswith({text}, '0')
        OR startswith({text}, '-0')"""
    return f"""CASE WHEN {text} IS NULL OR {text} = '' THEN false
        WHEN {doubtful} THEN {present_variant(value)} ELSE true END"""


def present(value: str, kind: T.DataType) -> str:
    """Truth of a typed column."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return f"coalesce(length({value}) > 0, false)"
    if isinstance(kind, T.BooleanType):
        return f"coalesce({value}, false)"
    if isinstance(kind, T.NumericType):
        return f"coalesce({value} <> 0, false)"
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return f"coalesce(size({value}) > 0, false)"
    if isinstance(kind, T.VariantType):
        return present_variant(value)
    return f"({value} IS NOT NULL)"


def count_true(conditions: list[str]) -> str:
    """How many of the conditions hold."""
    return " + ".join(f"CAST({one} AS INT)" for one in conditions)


def completeness(df: DataFrame, columns: list[str]) -> str:
    """Number of columns of ``df`` that hold a present value."""
    return count_true([present(name, df.schema[name].dataType) for name in columns])
