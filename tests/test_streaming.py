"""The incremental directory equals the batch one, however the files arrive."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from placebook.operators.dedupe import dedupe
from placebook.operators.normalise import listings, normalise
from placebook.plans.directory import build_directory
from placebook.sources.documents import parse_texts, scan_documents
from placebook.streaming.replies import keep_directory, keep_progress, read_progress, reply_stream
from placebook.streaming.store import add_batch, compact, manifest, publish, read_directory, read_rejected


def _facts(directory):
    rows = directory.collect()
    return {(r.listing_key, r.file, r.pos, r.filled, tuple(r.first_seen), r.sightings, r.phone) for r in rows}


def _arrive(folder, names, seed):
    pick = random.Random(seed)
    for name in names:
        rows = [
            {"company_name": f"Shop {pick.randrange(6)}", "phone": pick.choice([None, "1"]), "email": pick.choice([None, "e"])}
            for _ in range(8)
        ]
        (folder / f"{name}.json").write_text(json.dumps(rows))


def test_stream_equals_batch(spark, tmp_path):
    folder, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "ck")
    folder.mkdir()
    with pytest.raises(ValueError):
        read_directory(spark, store)

    def run():
        keep_directory(reply_stream(spark, str(folder), files_per_batch=2), store, checkpoint).awaitTermination()

    def batch():
        return _facts(dedupe(listings(normalise(scan_documents(spark, str(folder)))), ["file", "pos"]))

    _arrive(folder, ["e", "f", "g", "h", "i"], seed=1)
    run()
    assert _facts(read_directory(spark, store)) == batch()
    compact(spark, store)
    assert _facts(read_directory(spark, store)) == batch()
    # Files that come later sort before the others and win ties.
    _arrive(folder, ["a", "b", "c"], seed=2)
    (folder / "cut.json").write_text("[")
    run()
    assert _facts(read_directory(spark, store)) == batch()
    compact(spark, store)
    compact(spark, store)
    run()
    assert _facts(read_directory(spark, store)) == batch()


def test_a_repeated_batch_counts_once(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    _arrive(folder, ["a", "b"], seed=3)
    for attempt in range(2):
        stream = reply_stream(spark, str(folder))
        keep_directory(stream, store, str(tmp_path / f"ck{attempt}")).awaitTermination()
    expected = dedupe(listings(normalise(scan_documents(spark, str(folder)))), ["file", "pos"])
    assert _facts(read_directory(spark, store)) == _facts(expected)


def test_progress(spark, tmp_path):
    folder = tmp_path / "in"
    for part in range(3):
        rows = [(f"t{part}{i}", i % 4 != 0) for i in range(10)]
        spark.createDataFrame(rows, "task_id string, success boolean").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("task_id string, success boolean").option("maxFilesPerTrigger", 1)
    path = str(tmp_path / "out")
    keep_progress(stream.parquet(str(folder)), path, str(tmp_path / "ck")).awaitTermination()
    assert tuple(read_progress(spark, path).first()) == (30, 21, 9)


def test_many_batches_leave_few_parts_and_rewrite_little(spark, tmp_path):
    """As Spark hands batches over: one after another, each with its number."""
    store, written, counts = str(tmp_path / "s"), 0, []
    for batch in range(27):
        rows = [(f"f{batch:02}.json", json.dumps([{"company_name": f"Firm {batch % 5}"}, {"company_name": f"Only {batch}"}, 7 if batch % 3 else []]))]
        texts = spark.createDataFrame(rows, "file string, value string")
        before = {p.name for p in manifest(spark, store).parts}
        add_batch(parse_texts(texts), batch, store, merge_every=3, retain=2)
        state = manifest(spark, store)
        merged = [p for p in state.parts if p.level and p.name not in before]
        written += sum(spark.read.parquet(f"{store}/parts/{p.name}/winners").count() for p in merged)
        counts.append(len(state.live()))
        assert len(state.live()) <= 2 * 3 + 1
        assert len(glob.glob(f"{store}/manifest/version=*")) <= 2
    assert counts[8] == counts[26] == 1 and manifest(spark, store).live()[0].files == 27
    # Merged parts go after two versions, and each row was written at most once for each of three levels.
    assert len(glob.glob(f"{store}/parts/*")) <= 1 + 3 * 3 and glob.glob(f"{store}/records/*") == []
    assert written <= 3 * (27 * 2)
    found = {r.company_name: r.sightings for r in read_directory(spark, store).collect()}
    assert found == {f"Only {i}": 1 for i in range(27)} | {f"Firm {i}": 6 if i < 2 else 5 for i in range(5)}
    assert read_rejected(spark, store).count() == 0


def test_a_finished_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "s")
    texts = spark.createDataFrame([("a.json", '[{"company_name": "A"}, 1]'), ("b.json", "{")], "file string, value string")
    for batch in (0, 1, 0, 1, 2):
        add_batch(parse_texts(texts.withColumn("file", F.concat(F.lit(str(batch)), "file"))), batch, store, merge_every=2)
    assert [(r.company_name, r.sightings) for r in read_directory(spark, store).collect()] == [("A", 3)]
    assert read_rejected(spark, store).count() == 3


def test_a_batch_that_failed_half_way_is_written_anew(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    texts = spark.createDataFrame([("a.json", '[{"company_name": "A"}]')], "file string, value string")
    add_batch(parse_texts(texts), 0, store)

    def fail(*args):
        raise OSError("no space")

    with monkeypatch.context() as patched, pytest.raises(OSError):
        patched.setattr("placebook.streaming.store._commit", fail)
        add_batch(parse_texts(texts.withColumn("file", F.lit("b.json"))), 1, store)
    assert read_directory(spark, store).first().sightings == 1
    add_batch(parse_texts(texts.withColumn("file", F.lit("c.json"))), 1, store)
    row = read_directory(spark, store).first()
    assert (row.sightings, row.file) == (2, "a.json") and manifest(spark, store).last_batch == 1


def test_a_store_is_published_like_a_batch_run(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    _arrive(folder, "abcdefg", seed=5)
    (folder / "cut.json").write_text("[")
    (folder / "odd.json").write_text('{"businesses": 7}')
    stream = reply_stream(spark, str(folder), files_per_batch=2)
    keep_directory(stream, store, str(tmp_path / "ck"), merge_every=2).awaitTermination()
    ours = publish(spark, store, str(tmp_path / "o1"), ("csv", "document"))
    batch = build_directory(spark, str(folder), str(tmp_path / "o2"), formats=("csv",))
    assert ours.summary.collect() == batch.summary.collect()
    assert ours.by_state.collect() == batch.by_state.collect()
    assert sorted(ours.rejected.collect()) == sorted(batch.rejected.collect())

    def lines(path):
        return "".join(open(p, newline="").read() for p in sorted(glob.glob(f"{path}/part-*")))

    assert lines(ours.output_files[1]) == lines(batch.output_files[0])
    with pytest.raises(ValueError):
        publish(spark, str(tmp_path / "none"), str(tmp_path / "o3"))
