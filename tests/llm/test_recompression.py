import hashlib
import random
import re

import numpy as np
import pytest

from placebook.llm.recompression import anchors, without_repeats
from tests.llm.cases import collected, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")


def expected(rows, window=50):
    first = {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(doc, first.get(key, doc))
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        yield doc, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left


def repeats(seed):
    """Passages of many lengths, copied whole and in part, among loops and runs over few words."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 5, 300]))]
    pool = [[rng.choice(vocabulary) for _ in range(rng.choice([30, 50, 51, 70, 140]))] for _ in range(6)]
    rows = []
    for doc in range(40):
        text = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            cut = rng.randint(0, 10)
            text += rng.choice([p, p[cut:], p[: len(p) - cut], ["a"] * rng.randint(1, 120), ["x", "y"] * rng.randint(1, 60)])
            text += [rng.choice(vocabulary) for _ in range(rng.randint(0, 5))]
        rows.append((doc * 2, " ".join(text)))
    rng.shuffle(rows)
    return rows


def test_awkward_documents(docs, rows, tmp_path):
    assert collected(without_repeats(docs, str(tmp_path)), *COLUMNS) == sorted(expected(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_among_runs_and_loops(spark, tmp_path, seed):
    rows = repeats(seed)
    got = collected(without_repeats(frame(spark, rows), str(tmp_path)), *COLUMNS)
    assert got == sorted(expected(rows))
    assert any(r[2] for r in got) and any(r[1] > r[2] for r in got)


@pytest.mark.parametrize("seed", range(12))
def test_equal_windows_have_equal_anchors(seed):
    rng = np.random.default_rng(seed)
    passage = rng.integers(1, [3, 50, 10**9][seed % 3], 50).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    seen = set()
    for _ in range(40):
        left, right = (rng.integers(1, 3, rng.integers(0, 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        starts, anchor = anchors(np.concatenate([left, passage, right]), np.array([0, len(left) + 50 + len(right)]), 50, 4)
        seen.add(int(anchor[np.flatnonzero(starts == len(left))[0]]))
    assert len(seen) == 1


def test_whole_small_table(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = collected(without_repeats(frame(spark, rows), str(tmp_path)), *COLUMNS)
    assert got == sorted(expected(rows))


def test_repeated_rows_null_ids_and_an_empty_table(spark, nothing, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(4, text), (4, text), (9, text + " end"), (None, text), (None, None)])
    out = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in without_repeats(docs, f"{tmp_path}/a").collect())
    assert out == [(0, 0, 0), (0, 60, 60), (4, 60, 0), (4, 60, 0), (9, 61, 60)]
    assert without_repeats(nothing, f"{tmp_path}/b").count() == 0
