import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from placebook.llm.bit_sliced_resampling import Draw, features, gain_planes, gains, numbered, resampled, weighted_sums
from placebook.llm.words import texts
from tests.llm import cases

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BENCHMARK = [(1, cases.PASSAGE), (2, "w1 w2 w3 b c d x y z line one is here"), (3, None), (4, "")]


def runs_of(text, n):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lowered)
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute_force(rows, benchmark, draw):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % draw.buckets

    found = [(doc, *runs_of(text, draw.n)) for doc, text in rows]
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for _, text in benchmark for f in runs_of(text, draw.n)[1])
    total_s, total_t = sum(s.values()) + draw.buckets, sum(t.values()) + draw.buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t))) for b in s}
    out = []
    for doc, words, fs in found:
        weight = sum(gain[bucket(f)] for f in fs) // max(len(fs), 1)
        h = int(hashlib.sha256(f"{draw.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(words), len(fs), weight, score, None])
    able = sorted((r for r in out if r[1] >= draw.min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, row in enumerate(able[: draw.percent * len(able) // 100], 1):
        row[5] = place
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("draw", [Draw(), Draw(n=3, buckets=97, percent=50, min_words=2), Draw(percent=100), Draw(percent=0)])
def test_equals_brute_force(spark, tmp_path, rows, draw):
    rows = [*rows, (None, cases.PASSAGE * 3), (None, cases.PASSAGE * 3), *[(7, "w1 w2 b c d " * 9)] * 40]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row_no int, place string")
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    got = resampled(docs.repartition(5), benchmark, str(tmp_path), draw)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows, BENCHMARK, draw)


def test_empty_tables(spark, tmp_path, docs, nothing):
    target = spark.createDataFrame([], "item_id long, text string")
    assert resampled(nothing, target, f"{tmp_path}/a").collect() == []
    assert resampled(docs, target, f"{tmp_path}/b").count() == docs.count()


def test_planes_give_exact_sums():
    rng = np.random.default_rng(3)
    for low, high in ((-9000, 9000), (0, 5), (-5, 0), (0, 1)):
        gain = rng.integers(low, high, 1000)
        owner, bucket = rng.integers(0, 1300, 60_000), rng.zipf(1.3, 60_000) % 1000
        got = weighted_sums(owner, bucket, 1300, gain_planes(gain), 1000)
        assert got.tolist() == np.bincount(owner, gain[bucket], 1300).astype(int).tolist()


def test_a_very_long_text(spark, tmp_path):
    text = "alpha Beta " * 450_000 + "gamma"  # 5 MB
    docs = spark.createDataFrame([(1, text), (2, "gamma " * 30)], "doc_id long, text string")
    target = spark.createDataFrame([(1, "gamma")], "item_id long, text string")
    got = resampled(docs, target, str(tmp_path), Draw(percent=100)).orderBy("doc_id").collect()
    assert [r.n_features for r in got] == [900_001, 30]
    gain = gains(docs, target)
    assert got[0].weight == (450_000 * int(gain[zlib.crc32(b"alpha") % 10_000] + gain[zlib.crc32(b"beta") % 10_000]) + int(gain[zlib.crc32(b"gamma") % 10_000])) // 900_001


def test_runs_of_words_are_joined_by_one_space():
    import pyarrow as pa

    owner, bucket, n_words = features(texts(pa.array(["A,, b", None, "c"])), Draw(n=2, buckets=1 << 32))
    assert owner.tolist() == [0, 0, 2, 0] and n_words.tolist() == [2, 0, 1]
    assert bucket.tolist() == [zlib.crc32(x) for x in (b"a", b"b", b"c", b"a b")]


def test_ranks_of_one_hot_row_need_no_single_task(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("row_no"))
    rows = rows.withColumn("k", F.when(F.col("k") == 0, 5).otherwise(F.col("row_no")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would join so few rows
    try:
        got = numbered(rows, [F.col("k"), F.col("row_no")], str(tmp_path)).orderBy("k", "row_no").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["rank"] for r in got] == list(range(1, 20_001))
    placed = spark.read.parquet(str(tmp_path)).groupBy(F.shiftright("place", 33).alias("part")).count()
    assert placed.agg(F.max("count")).first()[0] < 20_000 / 2
