"""Every recorded reply comes back, whatever brackets it holds."""

import pytest

from placebook import catalog

duckdb = pytest.importorskip("duckdb")


def test_replies_with_brackets_are_returned(spark, tmp_path):
    said = ["plain", "see [2] and", "a ] b", "[1, 2] then", "{\"a\": 1} ", "", "[", None]
    turns = []
    for i, text in enumerate(said):
        turns += [(i, 0, "user", f"q{i}"), *([(i, 1, "assistant", text)] if text is not None else [])]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, catalog.queries()["successful_results"](spark, str(tmp_path)).select("task_id", "items", "turns", "id").collect()), key=str)
    assert [r[0] for r in got] == [f"{i}-0" for i in range(len(said) - 1)]
    assert ("0-0", 2, 5, "0-0") in got and ("2-0", 2, 5, "2-0") in got
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.sql(f"SELECT task_id, items, turns, id FROM ({catalog.oracles()['successful_results']})").fetchall()
    assert got == sorted(want, key=str)
