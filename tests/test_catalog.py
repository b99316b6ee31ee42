"""Every query that has SQL agrees with it, on the smallest test data."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from placebook import catalog  # noqa: E402

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        name = file.removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{file}'")
    return connection


def _comparable(rows):
    rounded = [tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows]
    return sorted(rounded, key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = _comparable(tuple(row) for row in df.select(*columns).collect())
    if name in catalog.oracles():
        relation = duck.sql(catalog.oracles()[name])
        assert sorted(relation.columns) == columns
        expected = relation.select(", ".join(f'"{c}"' for c in columns)).fetchall()
        assert got == _comparable(expected)
