"""Texts beyond a slice (4 MB) and beyond a group of packing (8 MB), and groups of equal rows beside them."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placebook.llm import (
    blob_ledger,
    compression_bands,
    elias_fano_ids,
    forest_join,
    hierarchical_packing,
    kneser_ney,
    recompression,
    virtual_slots,
    winnowing,
)

SECRET = ' token = "abcdef0123456789abcdef" '
PASSAGE = " ".join(f"bench{i}" for i in range(20))
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"{rng.randrange(10**6):x}" for _ in range(20_000)]
    long = " ".join(words[int(rng.random() ** 2 * 20_000)] for _ in range(1_000_000))  # about 6 MB
    half = long.index(" ", len(long) // 2)
    near = long[:half] + " changed here" + long[half:]
    special = long[:half] + f" {PASSAGE}" + SECRET + long[half + 1 :]
    short = " ".join(f"s{i}" for i in range(200))
    return [(1, long), (2, near), (3, special), *[(9, short)] * 40, (10, None), (11, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_packing(spark):
    piece = "the quick brown fox jumps over the lazy dog and on it goes. "
    text = piece * 150_000  # 9 MB
    rows = [(1, text), (2, "short"), *[(3, piece)] * 5]
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = hierarchical_packing.packed_pieces(spark.createDataFrame(rows, "doc_id long, text string"), path, 2).collect()
    whole = Tokenizer.from_file(path)
    want = [len(whole.encode(t, add_special_tokens=False).ids) + 1 for t in (piece * 2, piece * 3)]
    tokens = want[0] + (want[1] - want[0]) * (150_000 - 2)  # every further sentence adds the same ids
    own = sorted((p.start, p.length) for p in pieces if p.doc_id == 1)
    assert sum(n for _, n in own) == tokens == next(p.doc_tokens for p in pieces if p.doc_id == 1)
    assert all(a + n == b for (a, n), (b, _) in zip(own[:-1], own[1:], strict=True))


def test_winnowing(spark, docs, rows):
    items = spark.createDataFrame([(5, PASSAGE), (6, "not there " * 8)], "item_id long, text string")
    got = by_id(winnowing.decontaminated(docs, items))
    assert (got[3].n_hit, got[3].n_items, got[3].contaminated) == (20, 1, False)
    assert got[1].n_hit == got[2].n_hit == 0 and got[9].n_words == 200
    assert got[1].n_words == len(SPLIT.findall(rows[0][1]))


def test_virtual_slots(docs, rows, tmp_path):
    got = virtual_slots.sharded(docs, 3, folder=str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.text_crc32 for r in got}[2] == zlib.crc32(rows[1][1].encode())


def test_recompression(docs, rows, tmp_path):
    got = by_id(recompression.without_repeats(docs, str(tmp_path)))
    n = len(SPLIT.findall(rows[0][1]))
    assert (got[1].n_words, got[1].n_removed) == (n, 0)
    assert got[2].n_removed == n and got[2].n_words == n + 2
    assert got[2].kept_sha256 == hashlib.sha256(b"changed here").hexdigest()
    assert got[3].n_removed == n
    assert got[9].n_removed == 0  # equal ids remove nothing from each other


def test_compression_bands(docs, rows):
    got = by_id(compression_bands.judged(docs))
    text = rows[2][1]
    assert got[3].n_words == len(SPLIT.findall(text)) and got[3].word_chars == sum(map(len, SPLIT.findall(text)))
    assert got[3].n_chunks == round(len(text) / 4096) and not got[9].base_failed and got[10].base_failed


def test_blob_ledger(docs, tmp_path):
    got = by_id(blob_ledger.secrets(docs, str(tmp_path)))
    assert got[3].n_assign == 1 and got[1].n_assign == got[9].n_assign == 0
    masked = by_id(blob_ledger.masked(docs, f"{tmp_path}/m"))
    assert "[secret]" in masked[3].text and "abcdef0123456789" not in masked[3].text and masked[1].text == by_id(docs)[1].text


def test_kneser_ney(docs, rows, tmp_path):
    got = by_id(kneser_ney.scored(docs, str(tmp_path)))
    n = len(SPLIT.findall(rows[0][1]))
    assert got[1].n_tokens == n + 1 and got[3].n_tokens == n + 20 + 3 + 1
    assert got[1].score < 0 and abs(got[1].score - got[2].score) < 100


def test_forest_join(docs, tmp_path):
    got = by_id(forest_join.joined(docs, str(tmp_path)))
    assert {got[i].class_id for i in (1, 2, 3)} == {1} and got[1].n_text_links == 2
    assert got[9].n_links == 39 and got[9].n_text_links == 0 and got[10].n_links == 0


def test_elias_fano_ids(spark, tmp_path):
    piece = "the quick brown fox jumps over the lazy dog and on it goes. "
    rows = [(1, piece * 100_000), (2, None), *[(3, piece)] * 5]  # 6 MB
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    files = elias_fano_ids.write(docs, str(tmp_path), elias_fano_ids.Tokens(path, 2), shards=2)
    got = elias_fano_ids.read_back(docs, str(tmp_path), files).orderBy("start").collect()
    whole = Tokenizer.from_file(path)
    two, three = (len(whole.encode(piece * k, add_special_tokens=False).ids) for k in (2, 3))
    assert [r.n_tokens for r in got][:2] == [two + (three - two) * 99_998 + 1, 1]
    assert len(got) == 7 and got[-1].start == sum(r.n_tokens for r in got[:-1])


def test_pipeline_stages_take_them(spark, docs):
    import corpus_pipeline

    given = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").alias("n_chars"))
    kept = corpus_pipeline.near_duplicates(spark, given, "/root/testdata/sf0.001")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 9, 10, 11]
