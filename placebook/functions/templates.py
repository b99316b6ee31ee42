"""Fill text patterns from columns, and write values as JSON text."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fill(pattern: str, **values: Column) -> Column:
    """The pattern with each ``{name}`` replaced by a column; null becomes empty."""
    parts = []
    for text, name, _, _ in Formatter().parse(pattern):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(F.coalesce(values[name], F.lit("")))
    return F.concat(*parts)


def ascii_only(json_text: Column) -> Column:
    """JSON text with every character outside printable ASCII written as ``\\uXXXX``."""

    def escape(char: Column) -> Column:
        units = F.lower(F.hex(F.encode(char, "UTF-16BE")))
        escaped = F.regexp_replace(units, "(.{4})", r"\\u$1")
        return F.when(char.rlike("[^ -~]"), escaped).otherwise(char)

    plain = ~json_text.rlike("[^ -~]")
    spelled = F.array_join(F.transform(F.split(json_text, ""), escape), "")
    return F.when(plain, json_text).otherwise(spelled)


def json_text(value: Column, kind: T.DataType) -> Column:
    """One value as JSON text, lists with a blank after each comma."""
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda item: json_text(item, kind.elementType))
        listed = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
        return F.coalesce(listed, F.lit("null"))
    if isinstance(kind, T.VariantType):
        return F.coalesce(ascii_only(F.to_json(value)), F.lit("null"))
    wrapped = F.to_json(F.array(value))
    return ascii_only(F.substring(wrapped, F.lit(2), F.length(wrapped) - 2))


def json_object(fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    """Object with the given fields in order; null fields are left out."""
    members = [
        F.when(value.isNotNull(), F.concat(F.lit(f'"{name}": '), json_text(value, kind)))
        for name, (value, kind) in fields.items()
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
