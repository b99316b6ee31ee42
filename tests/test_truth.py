import json

from pyspark.sql import functions as F

from placebook.functions.truth import completeness, present_field, present_variant

VALUES = [
    "null", '""', "0", "0.0", "-0", "0e5", "1e-400", "false", "[]", "{}",
    '" "', '"0"', '"false"', '"[]"', "[0]", "[[]]", '{"a":null}', "1", "-0.5", "true", '"-0"', "0.50",
]


def test_variant_truth_is_that_of_the_json_value(column):
    expected = [bool(json.loads(value)) for value in VALUES]
    assert column(VALUES, lambda _: F.expr(present_variant("parse_json(x)"))) == expected
    assert column([None], lambda _: F.expr(present_variant("try_parse_json(x)"))) == [False]
    by_text = present_field("parse_json(x)", "variant_get(parse_json(x), '$', 'string')")
    assert column(VALUES, lambda _: F.expr(by_text)) == expected


def test_a_column_named_like_an_inner_name_is_safe(spark):
    for name in ("members", "json_kind", "value", "kind"):
        df = spark.sql(f"SELECT parse_json('\"x\"') AS {name}")
        assert df.select(F.expr(present_variant(name))).first()[0] is True


def test_completeness_counts_by_type(spark):
    df = spark.sql(
        """SELECT 'a' s, '' e, CAST(NULL AS STRING) n, 0 z, 5 i, false f, true t,
           array() l, array(1) m, parse_json('[]') v, parse_json('[0]') w"""
    )
    assert df.select(F.expr(completeness(df, df.columns))).first()[0] == 5
