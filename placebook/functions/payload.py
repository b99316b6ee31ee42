"""JSON inside free text, as variants; null where there is none.

Needs ``prepare(spark)``. The functions take the text as a SQL expression, mostly a column
name. Everything stays in built-in expressions, so whole replies of any length are read once
per attempt inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from placebook.fixed_values import BLANKS
from placebook.functions.once import let

# A number no reply is expected to hold; one that does takes the slower exact check.
_GUARD = "864691128455135232"

# The blanks JSON allows around a value.
_JSON_BLANKS = " \t\n\r"


def _strict(text: str) -> str:
    # Spark's parser stops after the first value and ignores what follows. Putting the text
    # into an array in front of a guard number makes anything after the value visible.
    guarded = let(
        "pair",
        f"try_parse_json(concat('[', trimmed, ',{_GUARD}]'))",
        f"""CASE WHEN variant_get(pair, '$[1]', 'string') = '{_GUARD}'
            THEN variant_get(pair, '$[0]', 'variant') END""",
    )
    in_list = "try_parse_json(concat('[', trimmed, ']'))"
    alone = f"""CASE WHEN try_parse_json(concat('{{"v":', trimmed, '}}')) IS NOT NULL
        AND variant_get({in_list}, '$[1]', 'variant') IS NULL
        THEN variant_get({in_list}, '$[0]', 'variant') END"""
    parsed = f"CASE WHEN contains(trimmed, '{_GUARD}') THEN {alone} ELSE {guarded} END"
    # Prose is told by its first character; a failed parse costs far more than a look.
    starts = ", ".join(f"'{char}'" for char in '{["-0123456789')
    words = f"rtrim('{_JSON_BLANKS}', trimmed) IN ('true', 'false', 'null')"
    return let(
        "trimmed",
        f"ltrim('{_JSON_BLANKS}', {text})",
        f"CASE WHEN substring(trimmed, 1, 1) IN ({starts}) OR {words} THEN {parsed} END",
    )


def _widest(text: str, opening: str, closing: str) -> str:
    # One greedy pass to the first opening bracket, to the end, and back to the last closing one. Without
    # the anchor a text of opening brackets only would be searched once from each of them.
    pattern = f"(?s)^[^\\{opening}]*+(\\{opening}.*\\{closing})"
    return f"nullif(regexp_extract({text}, r'{pattern}', 1), '')"


def _balanced(text: str, opening: str, closing: str) -> str:
    # Most spans hold no further bracket of their kind and end at the next closing one.
    plain = f"(?s)^[^\\{opening}]*+(\\{opening}[^\\{opening}\\{closing}]*+\\{closing})"
    # Of others the rest of the text is cut at closing brackets. After piece i the brackets balance
    # when the pieces so far hold i + 1 openings, so the fold runs once per closing bracket and not
    # once per character. The piece after the last closing bracket has none behind it.
    pieces = f"split(rest, r'\\{closing}')"
    opened = f"length(piece) - length(replace(piece, '{opening}', ''))"
    step = f"""named_struct(
        'open', state.open + {opened} - 1,
        'read', state.read + length(piece) + 1,
        'end', CASE WHEN state.open + {opened} = 1 THEN state.read + length(piece) + 1 END)"""
    end = f"""aggregate(slice({pieces}, 1, size({pieces}) - 1),
        named_struct('open', 0, 'read', 0, 'end', CAST(NULL AS INT)),
        (state, piece) -> IF(state.end IS NOT NULL, state, {step}), state -> state.end)"""
    rest = f"nullif(regexp_extract({text}, r'(?s)^[^\\{opening}]*+(\\{opening}.*\\{closing})', 1), '')"
    nested = let("rest", rest, f"CASE WHEN rest IS NOT NULL THEN substring(rest, 1, {end}) END")
    return f"coalesce(nullif(regexp_extract({text}, r'{plain}', 1), ''), {nested})"


def _from_slices(text: str, cut: Callable[[str, str, str], str]) -> str:
    """Value of the list slice if it parses, else of the object slice."""
    return f"coalesce({_strict(cut(text, '[', ']'))}, {_strict(cut(text, '{', '}'))})"


def _greedy(text: str, prefer: str) -> str:
    slices = _from_slices(text, _widest)
    if prefer == "array":
        return slices
    if prefer != "outermost":
        raise ValueError(f"unknown preference {prefer!r}")
    brace, bracket = f"instr({text}, '{{')", f"instr({text}, '[')"
    object_first = f"{brace} > 0 AND ({bracket} = 0 OR {brace} < {bracket})"
    as_object = _strict(_widest(text, "{", "}"))
    return f"coalesce(CASE WHEN {object_first} THEN {as_object} END, {slices})"


def widest_slice(text: str, opening: str, closing: str) -> Column:
    """From the first opening to the last closing bracket; null if there is no such span."""
    return F.expr(_widest(text, opening, closing))


def balanced_slice(text: str, opening: str, closing: str) -> Column:
    """From the first opening bracket to where the brackets balance, null if they never do."""
    return F.expr(_balanced(text, opening, closing))


def strict_json(text: str) -> Column:
    """The text as one JSON value."""
    return F.expr(_strict(text))


def greedy_json(text: str, prefer: str = "array") -> Column:
    """Value of the widest bracketed span.

    ``array`` tries the list brackets first, also when the list sits inside an object, which
    is the behaviour results are compared with. ``outermost`` starts with whichever bracket
    comes first and so keeps the object around a list.
    """
    return F.expr(_greedy(text, prefer))


def reply_json(text: str, prefer: str = "array") -> Column:
    """Payload of a worker reply: the whole text if it is JSON, else the widest span."""
    return F.expr(f"coalesce({_strict(text)}, {_greedy(text, prefer)})")


def plan_json(text: str) -> Column:
    """Payload of a planner reply: the whole text, else the list span, else an empty list."""
    span = _strict(_widest(text, "[", "]"))
    return F.expr(f"coalesce({_strict(text)}, {span}, parse_json('[]'))")


def balanced_json(text: str) -> Column:
    """The whole text without outer blanks, else the first balanced list, else object.

    Brackets inside JSON strings count too, and one candidate per bracket kind is tried. A
    text that is just ``null`` has no value.
    """
    whole = let(
        "value", _strict(f"btrim({text}, '{BLANKS}')"),
        "CASE WHEN NOT is_variant_null(value) THEN value END",
    )
    return F.expr(f"coalesce({whole}, {_from_slices(text, _balanced)})")
