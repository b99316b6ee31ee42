import hashlib
import re

import pytest

from placebook.llm.winnowing import decontaminated
from tests.llm.cases import PASSAGE, collected, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def expected(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if items_of := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= items_of
        told = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc, len(w), len(hit), len(found), told, bool(hit) and 20 * len(hit) >= len(w)


def benchmark(spark, items):
    return spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string")


ITEMS = [
    (1, PASSAGE),
    (2, PASSAGE.replace("tau", "upsilon")),
    (10, "x, y; Z"),
    (11, "é a 日本語"),
    (12, None),
    (13, " ... "),
    (14, "a " * 13),
    (15, "a " * 13),
    (16, "nothing of this stands in any text at all so it finds none here ever"),
]


@pytest.mark.parametrize("gram", [1, 4, 6, 13])
def test_equals_brute_force(spark, docs, rows, gram):
    assert collected(decontaminated(docs, benchmark(spark, ITEMS), gram), *COLUMNS) == sorted(expected(rows, ITEMS))


def test_whole_small_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = collected(decontaminated(frame(spark, rows), benchmark(spark, items)), *COLUMNS)
    assert got == sorted(expected(rows, items))
    assert any(row[-1] for row in got)


def test_repeated_rows_null_ids_and_empty_tables(spark, nothing):
    items = benchmark(spark, ITEMS)
    out = decontaminated(frame(spark, [(1, PASSAGE), (1, PASSAGE), (1, "other"), (None, PASSAGE)]), items).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in out) == [(0, 19), (1, 0), (1, 19), (1, 19)]
    assert decontaminated(nothing, items).count() == 0
    assert decontaminated(frame(spark, [(1, PASSAGE)]), benchmark(spark, [])).first().n_hit == 0


def test_the_shuffled_join_gives_the_same(spark, docs, rows, monkeypatch):
    monkeypatch.setattr("placebook.llm.winnowing.BROADCAST_ROWS", 0)
    assert collected(decontaminated(docs, benchmark(spark, ITEMS)), *COLUMNS) == sorted(expected(rows, ITEMS))
