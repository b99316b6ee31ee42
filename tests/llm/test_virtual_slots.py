import zlib
from collections import defaultdict

import pytest

from placebook.llm.virtual_slots import SLOTS, SlotMap, first_map, rebalanced, sharded
from tests.llm.cases import frame


def check_law(out, rows, shards):
    load, slots = defaultdict(int), defaultdict(list)
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        assert 0 <= r.shard < shards
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [load[s] for s in range(shards)]


def test_rows_are_placed_once_with_gapless_positions(docs, rows, tmp_path):
    check_law(sharded(docs, 24, folder=str(tmp_path)).collect(), rows, 24)


def test_sizes_are_near_equal(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    load = check_law(sharded(frame(spark, rows), 24, folder=str(tmp_path)).collect(), rows, 24)
    assert max(load) - min(load) <= 0.002 * sum(load) / 24


def test_the_map_is_stored_by_version(spark, docs, tmp_path):
    sharded(docs, 5, folder=str(tmp_path)).collect()
    assert SlotMap.load(spark, f"{tmp_path}/map", 0) == first_map(5)
    used = SlotMap.load(spark, f"{tmp_path}/map", 1)
    assert used.version == 1 and len(used.shards) == SLOTS


def test_rebalancing_edits_the_map():
    sizes = [(slot * 7919) % 1000 for slot in range(SLOTS)]
    one = rebalanced(first_map(24), sizes, 24)
    assert rebalanced(one, sizes, 24).shards == one.shards  # balanced already: nothing moves
    moved = sum(a != b for a, b in zip(first_map(24).shards, one.shards, strict=True))
    assert moved < SLOTS / 10
    grown = rebalanced(one, sizes, 25)  # a shard more
    load = [sum(s for s, h in zip(sizes, grown.shards, strict=True) if h == shard) for shard in range(25)]
    assert max(load) - min(load) <= 2e-4 * sum(load) / 25


def test_null_ids_copies_and_an_empty_table(spark, nothing, tmp_path):
    out = sharded(frame(spark, [(None, "a"), (None, "a"), (1, None), (1, None)]), 2, folder=f"{tmp_path}/a").collect()
    assert len(out) == 4
    assert sharded(nothing, 3, folder=f"{tmp_path}/b").count() == 0


def test_a_second_run_edits_the_stored_map(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    folder = str(tmp_path)
    first = {r.doc_id: r.shard for r in sharded(frame(spark, rows[:900]), 6, folder=folder).collect()}
    grown = sharded(frame(spark, rows), 6, folder=folder).collect()
    load = check_law(grown, rows, 6)
    assert max(load) - min(load) <= 0.002 * sum(load) / 6
    # The old records stay where they were but for a few, and the output says which moved.
    assert all(first[r.doc_id] == r.from_shard for r in grown if r.doc_id in first)
    moved = [r for r in grown if r.from_shard != r.shard]
    assert 0 < len(moved) < 0.15 * len(rows)
    assert SlotMap.newest(spark, f"{folder}/map").version == 2
    # Nothing new: no new version. A shard less: its records go to the others.
    again = sharded(frame(spark, rows), 6, folder=folder).collect()
    assert sorted(again) == sorted(r for r in sharded(frame(spark, rows), 6, folder=folder).collect())
    assert SlotMap.newest(spark, f"{folder}/map").version == 2 and all(r.shard == r.from_shard for r in again)
    less = sharded(frame(spark, rows), 5, folder=folder).collect()
    check_law(less, rows, 5)
    assert sum(r.from_shard == r.shard for r in less) > 0.6 * len(rows)
    with pytest.raises(ValueError, match="never changes"):
        sharded(frame(spark, rows), 6, slots=16, folder=folder)


def test_records_without_an_id_spread(spark, tmp_path):
    rows = [(None, f"text {i}") for i in range(400)]
    out = sharded(frame(spark, rows), 4, folder=str(tmp_path)).collect()
    assert len({r.virtual_slot for r in out}) > 300
    load = [sum(r.size for r in out if r.shard == shard) for shard in range(4)]
    assert max(load) - min(load) <= 0.1 * sum(load) / 4
