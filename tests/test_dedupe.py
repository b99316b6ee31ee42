"""Deduplication against a plain loop, its invariants, and its plan."""

import random

import pytest

from placebook.operators.dedupe import dedupe, duplicate_counts, merge_winners, with_completeness
from placebook.operators.rollup import by_state

FIELDS = ["company_name", "city", "state", "phone", "email"]
SCHEMA = "file string, pos int, company_name string, city string, state string, phone string, email string"
KEYED = [*FIELDS, "file", "pos", "listing_key", "filled", "sightings"]


def _made_up(n, seed=0):
    """Rows of which a third belong to one business."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        name = "Hot Shop" if i % 3 == 0 else f"Shop {pick.randrange(40)}"
        name += pick.choice(["", " LLC", " Inc", " CO"])
        place = ("Waco", "tx") if i % 3 == 0 else (pick.choice(["Waco", "", None]), pick.choice(["TX", "CA", None]))
        rows.append((f"f{pick.randrange(9)}", i, name, *place, pick.choice(["", None, "1"]), pick.choice([None, "e"])))
    return rows


# Names with the keys they have, written by hand.
NAMES = {"Hot Shop": "hot shop"} | {f"Shop {n}": f"shop {n}" for n in range(40)}
KEYS = {name + ending: key for name, key in NAMES.items() for ending in ("", " LLC", " Inc", " CO")}
PLACES = {
    ("Waco", "tx"): "waco|TX", ("Waco", "TX"): "waco|TX", ("Waco", "CA"): "waco|CA", ("Waco", None): "waco|",
    ("", "TX"): "|TX", ("", "CA"): "|CA", ("", None): "|",
    (None, "TX"): "|TX", (None, "CA"): "|CA", (None, None): "|",
}


def _brute_force(rows):
    def key(row):
        return f"{KEYS[row[2]]}|{PLACES[row[3], row[4]]}"

    groups = {}
    for row in sorted(rows, key=lambda row: row[:2]):
        groups.setdefault(key(row), []).append(row)
    best = {k: max(group, key=lambda row: sum(map(bool, row[2:]))) for k, group in groups.items()}
    return {k: (best[k][:2], len(group), group[0][:2]) for k, group in groups.items()}


def _facts(winners):
    return {
        r.listing_key: ((r.file, r.pos), r.sightings, tuple(r.first_seen)) for r in winners.collect()
    }


@pytest.fixture(scope="module")
def listed(spark):
    return with_completeness(spark.createDataFrame(_made_up(900), SCHEMA), FIELDS).cache()


def test_equals_brute_force(listed):
    assert _facts(dedupe(listed, ["file", "pos"])) == _brute_force(_made_up(900))


def test_does_not_depend_on_partitions(listed):
    expected = _facts(dedupe(listed, ["file", "pos"]))
    for spread in (listed.repartition(7), listed.coalesce(1), listed.repartition(3, "company_name")):
        assert _facts(dedupe(spread, ["file", "pos"])) == expected


def test_is_idempotent(listed):
    once = dedupe(listed, ["file", "pos"])
    again = dedupe(once.drop("listing_key", "first_seen", "sightings"), ["file", "pos"])
    assert {k: v[0] for k, v in _facts(again).items()} == {k: v[0] for k, v in _facts(once).items()}


def test_merging_parts_equals_the_whole(listed):
    parts = [dedupe(listed.where(f"pos % 3 = {i}"), ["file", "pos"]) for i in range(3)]
    merged = merge_winners(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["file", "pos"])
    assert _facts(merged) == _facts(dedupe(listed, ["file", "pos"]))


def test_counts_add_up(spark, listed):
    counts = duplicate_counts(dedupe(listed, ["file", "pos"])).first()
    assert counts.total_records_found == 900
    assert counts.unique_records + counts.duplicates_removed == 900
    none = dedupe(listed.where("false"), ["file", "pos"])
    assert tuple(duplicate_counts(none).first()) == (0, 0, 0)


def test_punctuation_keeps_names_apart(spark):
    rows = [("a", 0, "Heart of Gold, Inc.", "", "", None, None), ("a", 1, "Heart Of Gold Inc.", "", "", None, None)]
    df = with_completeness(spark.createDataFrame(rows, SCHEMA), FIELDS)
    assert dedupe(df, ["file", "pos"]).count() == 2


def test_plan_reduces_before_one_shuffle(listed):
    plan = dedupe(listed, ["file", "pos"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "partial_min_by" in plan
    assert plan.index("min_by") < plan.index("Exchange hashpartitioning") < plan.index("partial_min_by")


def test_by_state(spark):
    rows = [("Waco", "TX"), ("Waco", "TX"), ("Plano", "TX"), ("", "CA"), (None, "CA"), ("x", ""), ("y", None), ("x", None)]
    df = spark.createDataFrame(rows, "city string, state string")
    got = [tuple(r) for r in by_state(df).collect()]
    assert got == [("CA", 0, 2), ("TX", 2, 3), ("Unknown", 2, 3)]
