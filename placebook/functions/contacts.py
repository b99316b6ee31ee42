"""Company names, keys, phones and web addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placebook.fixed_values import BLANKS, NAME_ENDINGS


def strip(text: Column) -> Column:
    """Remove blanks at both ends, for every blank Unicode knows."""
    return F.btrim(text, F.lit(BLANKS))


def name_key(name: Column, mode: str = "substring") -> Column:
    """Company name in comparable form.

    ``substring`` deletes each ending wherever it occurs, also inside words, which is the
    behaviour results are compared with. ``suffix`` deletes one ending at the end only.
    """
    key = strip(F.lower(F.coalesce(name, F.lit(""))))
    if mode == "suffix":
        endings = "|".join(ending.strip() for ending in NAME_ENDINGS)
        return F.regexp_replace(key, rf"[,.]?\s+(?:{endings})\.?$", "")
    if mode != "substring":
        raise ValueError(f"unknown mode {mode!r}")
    for ending in NAME_ENDINGS:
        key = F.replace(key, F.lit(ending), F.lit(""))
    return key


def listing_key(name: Column, city: Column, state: Column, mode: str = "substring") -> Column:
    """Key under which two listings count as the same business."""
    return F.concat_ws(
        "|",
        name_key(name, mode),
        F.lower(F.coalesce(city, F.lit(""))),
        F.upper(F.coalesce(state, F.lit(""))),
    )


def standard_phone(phone: Column) -> Column:
    """``(ddd) ddd-dddd`` for US numbers, the text itself for others, null when empty."""
    digits = F.regexp_replace(phone, r"[^\p{Nd}]", "")
    national = F.when(F.length(digits) == 10, digits).when(
        (F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)
    )
    shaped = F.concat(
        F.lit("("), F.substring(national, 1, 3), F.lit(") "),
        F.substring(national, 4, 3), F.lit("-"), F.substring(national, 7, 4),
    )
    return F.when(phone != "", F.coalesce(shaped, phone))


def standard_url(url: Column) -> Column:
    """Web address with a scheme, null when empty."""
    bare = strip(url)
    has_scheme = bare.startswith("http://") | bare.startswith("https://")
    return F.when(url != "", F.when(has_scheme, bare).otherwise(F.concat(F.lit("https://"), bare)))


def search_task_id(state: Column, city: Column) -> Column:
    """Id of a city task; blanks inside the city name are dropped."""
    return F.concat_ws("_", F.lit("search"), state, F.regexp_replace(city, r"(?U)\s", ""))


def joined(values: Column) -> Column:
    """List as text, separated by a comma and a blank."""
    return F.array_join(values, ", ")
