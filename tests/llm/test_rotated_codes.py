import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from placebook.llm.rotated_codes import Block, Search, codes, coded, intervals, mined, participants, rotated

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute_force(rows, every=100, low=80):
    known = set()
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) or abs(x) >= 65536 for x in vector):
            continue
        whole = tuple(math.floor(256 * float(np.float32(x))) for x in vector)
        known.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, whole))
    out = []
    for a in known:
        if a[0] % every:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a[2], b[2], strict=False)), b) for b in known if b is not a), key=lambda p: (-p[0], p[1][0]))
        for best, positive in [p for p in scored if p[1][1] == a[1]][:5]:
            fits = [p for p in scored if p[1][1] != a[1] and low * best <= 100 * p[0] <= 100 * best]
            out += [(a[0], positive[0], k, b[0], best, score) for k, (score, b) in enumerate(fits[:5], 1)]
    return sorted(out)


def vectors(n, size, rng, labels=4):
    centres = rng.normal(size=(6, size))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=size) * rng.choice([0.0, 0.3, 1.0])
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(labels)), "x", 1))
    return rows


@pytest.mark.parametrize("size, search", [(64, Search()), (10, Search(block_rows=(50, 50), group_anchors=2)), (130, Search(levels=1, planes=3, block_rows=(97, 97)))])
def test_equals_brute_force(spark, tmp_path, size, search):
    rng = np.random.default_rng(size)
    rows = vectors(420, size, rng)
    rows[200] = (200, rows[100][1], rows[100][2], "x", 1)  # equal vectors
    zero, nan, inf = [0.0] * size, float("nan"), float("inf")
    rows += [(1000 + i, rows[i][1], rows[i][2], "x", 1) for i in range(0, 60)]  # ties
    rows += [
        (600, zero, 1, "x", 1), (601, None, 1, "x", 1), (700, [nan] * size, 1, "x", 1), (702, [inf] * size, 1, "x", 1),
        (703, [None] * size, 1, "x", 1), (704, rows[3][1], None, "x", 1), (None, rows[3][1], 1, "x", 1), (800, [], 2, "x", 1),
        (801, [1.0, -1.0], 2, "x", 1), (900, [300.5] * size, 2, "x", 1), (901, [1e30] * size, 2, "x", 1),
        *[rows[300]] * 30, (300, rows[8][1], 3, "x", 1), (-100, rows[9][1], 3, "x", 1),
    ]
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path), search)
    assert got.columns == list(COLUMNS)
    want = brute_force(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 40


def test_empty_tables_and_tables_without_anchors(spark, tmp_path):
    assert mined(spark.createDataFrame([], SCHEMA), f"{tmp_path}/a").collect() == []
    assert mined(spark.createDataFrame([(1, [1.0], 2, "", 0)], SCHEMA), f"{tmp_path}/b").collect() == []
    assert mined(spark.createDataFrame([(100, [1.0], 2, "", 0)], SCHEMA), f"{tmp_path}/c").collect() == []


def test_one_label_and_one_vector_for_all(spark, tmp_path):
    rows = [(i, [0.5, 0.5], 1, "", 0) for i in range(1, 300)]
    assert sorted(map(tuple, mined(spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect())) == brute_force(rows)


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(0).normal(size=(5, 128))
    turned = rotated(x, 3)
    assert np.allclose(turned @ turned.T, x @ x.T)
    assert not np.allclose(turned, x)


def block_of(rows, search):
    return Block.of(coded(participants(rows), 64, search).withColumn("row_no", F.monotonically_increasing_id()).toArrow(), search)


def test_intervals_hold_every_score_and_tell_most_pairs_apart(spark):
    rows = spark.createDataFrame(vectors(600, 64, np.random.default_rng(9)), SCHEMA)
    widths = []
    for search in (Search(), Search(levels=1)):
        block = block_of(rows, search)
        low, high = intervals(block.part(np.arange(40)), block, search)
        true = block.whole[:40].astype(np.int64) @ block.whole.astype(np.int64).T
        assert (low <= true).all() and (true <= high).all()
        widths.append((high - low).mean())
    assert widths[0] < 0.35 * widths[1]


def test_codes_and_rest_make_up_the_vector():
    whole = np.random.default_rng(2).integers(-300, 300, (7, 64)).astype(np.int32)
    bits, aligned, lengths = codes(whole, Search(levels=3))
    signs = np.where(np.unpackbits(bits.view(np.uint8), axis=-1, bitorder="little").reshape(7, 3, 64), 1, -1) / 8
    rest = rotated(whole / lengths[:, :1], Search().seed) - (aligned[:, :, None] * signs).sum(1)
    assert np.allclose((rest**2).sum(1), lengths[:, 1] ** 2)
    assert np.allclose((rest * signs[:, 2]).sum(1), 0)
