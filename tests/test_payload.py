"""JSON cut out of texts, against a plain restatement of the rules with Python's parser."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placebook.functions.payload import (
    balanced_json,
    greedy_json,
    plan_json,
    reply_json,
    strict_json,
)

MISSING = object()
BLANK = " \t\n\r"


def loads(text):
    """Strict JSON; the words Python adds to JSON are not JSON here."""

    def refuse(word):
        raise ValueError(word)

    try:
        return json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError, TypeError):
        return MISSING


def first_of(*values):
    return next((value for value in values if value is not MISSING), MISSING)


def widest(text, pair):
    found = re.search(re.escape(pair[0]) + ".*" + re.escape(pair[1]), text, re.S)
    return loads(found.group()) if found else MISSING


def balanced(text, pair):
    start = text.find(pair[0])
    if start < 0:
        return MISSING
    for end in range(start + 1, len(text) + 1):
        part = text[start:end]
        if part.count(pair[0]) == part.count(pair[1]):
            return loads(part)
    return MISSING


def greedy(text):
    return first_of(widest(text, "[]"), widest(text, "{}"))


def outermost(text):
    brace, bracket = text.find("{"), text.find("[")
    object_first = brace >= 0 and (bracket < 0 or brace < bracket)
    pairs = ("{}", "[]") if object_first else ("[]", "{}")
    return first_of(*[widest(text, pair) for pair in pairs])


def scan(text):
    whole = loads(text.strip())
    if whole is MISSING or whole is None:
        return first_of(balanced(text, "[]"), balanced(text, "{}"))
    return whole


RULES = {
    "strict": (lambda: strict_json("x"), loads),
    "greedy": (lambda: greedy_json("x"), greedy),
    "outermost": (lambda: greedy_json("x", "outermost"), outermost),
    "reply": (lambda: reply_json("x"), lambda t: first_of(loads(t), greedy(t))),
    "plan": (lambda: plan_json("x"), lambda t: first_of(loads(t), widest(t, "[]"), [])),
    "balanced": (lambda: balanced_json("x"), scan),
}

TEXTS = [
    "", " ", "null", " null ", "5", "-1.5e3", '"x"', "true", "tru", "trues", "NaN", "[NaN]", "-Infinity",
    '{"a":1}', ' [1,2]\n', "[1,2] tail", '{"a":[1]} tail', "1,2", "1] tail", "1} tail", "1, ", "[1,]",
    "\x0b[1]", "\xa0[1]\xa0", '"a\nb"', "01", "+1", ".5", "1.", "[", "]", "{}", "[]", "] [", "} {",
    'p {"a":[1]} q', '[x] {"a":1}', "p [1] q [2]", 'p ["]"] q', 'p {"a":1} q', 'x {"a":{"b":2}} q {"c":3}',
    'I found [2] sources:\n{"businesses": [{"n": "A"}]}', '{"businesses": [{"n": "[A]"}]} see [2]',
    "[[1],[2]] [3]", "[[1],[2", '{"a":1,"a":2}', '{"é":"😀 [ü]"}', '"[1]" and {"k": "}"}',
    "1,864691128455135232] t", "864691128455135232", "[864691128455135232]", "1,864691128455135232",
    '{"id": 864691128455135232} tail', 'x {"id": 864691128455135232} y', "1} 864691128455135232",
    "false]", 'text with "quotes" only', "[" * 50 + "]" * 50, "[" * 50 + "]" * 49, "{[}]", "[{]}",
]


def found(column, rule, texts):
    def spelled(_):
        value = RULES[rule][0]()
        return F.when(value.isNull(), "nothing").otherwise(F.to_json(value))

    got = column(texts, spelled)
    return [MISSING if one == "nothing" else json.loads(one) for one in got]


@pytest.mark.parametrize("rule", RULES)
def test_awkward_texts(column, rule):
    got = found(column, rule, TEXTS)
    expected = [RULES[rule][1](text) for text in TEXTS]
    wrong = [(t, g, e) for t, g, e in zip(TEXTS, got, expected, strict=True) if g != e]
    assert wrong == []


pieces = st.sampled_from(
    ["[", "]", "{", "}", '{"a":1}', "[1]", '"]"', '"', ":", ",", "1", "null", " ", "x", "é", "\\", "-"]
)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(pieces, max_size=9).map("".join), min_size=300, max_size=400))
def test_random_texts(column, texts):
    for rule, (_, expect) in RULES.items():
        got = found(column, rule, texts)
        wrong = [(t, g) for t, g in zip(texts, got, strict=True) if g != expect(t)]
        assert wrong == [], rule


def test_long_text_is_used_whole(column):
    filler = "prose with (brackets) " * 20_000
    text = f'{filler}{{"businesses": [{{"company_name": "Last One"}}]}}{filler}'
    assert found(column, "reply", [text]) == [[{"company_name": "Last One"}]]
    assert found(column, "balanced", [text]) == [[{"company_name": "Last One"}]]


def test_unknown_preference():
    with pytest.raises(ValueError):
        greedy_json("x", "inner")
