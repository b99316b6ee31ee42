"""Every query agrees with its SQL over the smallest tables, and runs over others without one."""

import os

import duckdb
import pytest

import __spark_entry__
from placebook.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    want = relation.select(", ".join(columns)).fetchall()
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_all_are_registered():
    known = __spark_entry__.queries()
    assert set(QUERIES) < set(known) and "pipeline" in known
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_sql_of_aliases(spark, duck, tmp_path):
    """The given pages have no alias, so the SQL is held against awkward ones as well."""
    from placebook.llm.redirect_equivalence import judged

    rows = [
        (1, "http://a.org/1", "<link href='http://b.net/es/1' rel=canonical>"),
        (2, "http://c.org/2", '<meta http-equiv="refresh" content="0; URL=http://a.org/1#frag">'),
        (3, "http://D.org/q/3?x=1", "<link rel='canonical' href='x?y&amp;z'>"),
        (4, "http://d.org/q/x?y&z", '<link rel="canonical" href="//e.net/fr/">'),
        (5, "http://f.org", "<link rel=canonical href=http://g.com/><meta http-equiv=refresh content='1;url=http://h.net/es/'>"),
        (6, None, None),
        (7, "no scheme", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    table = pages.toArrow()
    other = duckdb.connect()
    other.register("pages", table)
    want = other.sql(ORACLES["op3_redirect_equivalence"]).select("page_id, host, path, rule, verdict").fetchall()
    got = judged(pages, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r.verdict == "block" for r in got) >= 4
