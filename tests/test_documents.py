"""Folders of documents, and documents of every shape."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from placebook.operators.normalise import listings, normalise, rejected
from placebook.plans.directory import build_directory
from placebook.sources.documents import (
    parse_texts,
    quarantined,
    readable,
    scan_documents,
    scan_raw_replies,
)
from placebook.sources.kept_texts import kept_texts, update_texts


@pytest.fixture
def folder(tmp_path):
    def write(**files):
        for name, text in files.items():
            path = tmp_path / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(tmp_path)

    return write


def test_scan_takes_json_files_of_the_folder_only(spark, folder):
    path = folder(**{
        "a b+c%20é.json": '{"x": 1}', "list.json": " [1]\n", "notes.txt": "1", "sub/inner.json": "1",
        "old_raw.json": "1", "cut.json": '{"x": ', "tail.json": "[1] and more", "empty.json": "",
        "bytes.json": b'{"x": "\xff"}', "nan.json": "NaN",
    })
    scanned = scan_documents(spark, path)
    good = {r.file: json.loads(r.j) for r in readable(scanned).select("file", F.to_json("v").alias("j")).collect()}
    assert good == {"a b+c%20é.json": {"x": 1}, "list.json": [1]}
    bad = {r.file: r.problem for r in quarantined(scanned).collect()}
    # Spark's file sources leave out files without a byte, so an empty one is not reported.
    assert bad == {
        "cut.json": "not json", "tail.json": "not json", "nan.json": "not json",
        "bytes.json": "encoding",
    }


def test_reasons_for_texts(spark):
    rows = [("a", ""), ("b", " "), ("c", "{"), ("d", "null"), ("e_raw.json", "1")]
    parsed = parse_texts(spark.createDataFrame(rows, "file string, value string"))
    assert {r.file: r.problem for r in parsed.collect()} == {
        "a": "empty", "b": "not json", "c": "not json", "d": None
    }


def test_raw_replies(spark, folder):
    path = folder(**{"search_TX_El Paso_raw.txt": "I looked.\n[1]\n", "other.txt": "x"})
    rows = [tuple(r) for r in scan_raw_replies(spark, path).collect()]
    assert rows == [("search_TX_El Paso", "I looked.\n[1]\n")]


def _documents(spark, *values):
    rows = [(f"f{i}.json", json.dumps(value)) for i, value in enumerate(values)]
    texts = spark.createDataFrame(rows, "file string, value string")
    return texts.select("file", F.parse_json("value").alias("v"))


def _rows(spark, *values):
    found = listings(normalise(_documents(spark, *values)))
    return [r.asDict(recursive=True) for r in found.orderBy("file", "pos").collect()]


def test_envelope_hands_down_what_is_absent(spark):
    envelope = {"task_id": "t1", "city": "Waco", "state": "TX", "industry": "EMS"}
    businesses = [
        {"company_name": "A", "phone": "1"},
        {"company_name": ""},
        {"phone": "2"},
        {"company_name": "B", "city": "Plano", "state": ""},
        {"company_name": "C", "city": None, "email": None, "website": "c.example"},
    ]
    a, b, c = _rows(spark, {**envelope, "businesses": businesses, "search_notes": "n"})
    assert (a["company_name"], a["city"], a["state"], a["pos"]) == ("A", "Waco", "TX", 0)
    assert (a["industry"], a["source_task"], a["filled"], a["extra"]) == ("EMS", "t1", 6, None)
    assert (b["city"], b["state"], b["pos"], b["filled"]) == ("Plano", "", 3, 4)
    assert (c["city"], c["email"], c["website"], c["filled"]) == (None, None, "c.example", 5)


def test_envelope_without_fields(spark):
    [row] = _rows(spark, {"businesses": [{"company_name": "A"}], "task_id": None})
    assert (row["city"], row["state"], row["industry"], row["source_task"]) == ("", "", "", None)
    [row] = _rows(spark, {"businesses": [{"company_name": "A"}], "industry": None})
    assert (row["industry"], row["source_task"], row["filled"]) == (None, "f0.json", 2)


def test_profile(spark):
    profile = {
        "task_id": "r1", "company_name": "A",
        "location": {"city": "Waco", "state": "TX", "address": "1 Main"},
        "contact": {"phone": "1", "email": None, "website": "a.example"},
        "business_details": {"fleet_size": 3}, "key_contacts": [], "industry": "ignored",
    }
    row, bare = _rows(spark, profile, {"company_name": ""})
    assert (row["city"], row["address"], row["website"], row["industry"]) == ("Waco", "1 Main", "a.example", None)
    assert row["filled"] == 8
    assert row["extra"]["business_details"].toPython() == {"fleet_size": 3}
    assert row["extra"]["online_presence"] is None
    assert (bare["company_name"], bare["city"], bare["source_task"], bare["filled"]) == ("", "", "f1.json", 1)


def test_bare_list_skips_what_is_no_business(spark):
    rows = _rows(spark, [5, None, "x", [], {"phone": "1"}, {"company_name": "A", "city": None, "task_id": "t"}])
    assert [(r["company_name"], r["city"], r["state"], r["source_task"], r["pos"]) for r in rows] == [
        ("A", None, "", "f0.json", 5)
    ]


def test_other_shapes_hold_nothing(spark):
    assert _rows(spark, {}, {"note": 1}, "text", 5, None, True, [], {"businesses": []}, {"businesses": {}}, {"businesses": ""}) == []
    marks = normalise(_documents(spark, {}, 5, [], {"businesses": []}, [{"company_name": "A"}, 1]))
    assert marks.where("first").count() == 5


def test_present_values_follow_their_json_type(spark):
    values = {"company_name": "A", "address": 0, "phone": "0", "website": False, "email": []}
    [row] = _rows(spark, [values])
    assert row["filled"] == 3
    [row] = _rows(spark, {"businesses": [{"company_name": "0", "phone": 5}], "industry": 0, "task_id": 0})
    assert (row["company_name"], row["phone"], row["filled"]) == ("0", "5", 2)


@pytest.mark.parametrize(
    ("value", "problems"),
    [
        ({"businesses": None}, {(0, "businesses is not a list")}),
        ({"businesses": 7}, {(0, "businesses is not a list")}),
        ({"businesses": {"a": 1}}, {(0, "businesses is not a list")}),
        ({"businesses": [1, {"company_name": "A"}, None]}, {(0, "business is not an object"), (2, "business is not an object")}),
        ({"businesses": [{"company_name": 5}]}, {(0, "company_name is not a text")}),
        ({"company_name": None}, {(0, "company_name is not a text")}),
        ({"company_name": ["A"]}, {(0, "company_name is not a text")}),
        ({"company_name": "A", "location": None}, {(0, "location is not an object")}),
        ({"company_name": "A", "contact": "x"}, {(0, "contact is not an object")}),
        ({"company_name": "A", "location": {"city": 5}}, {(0, "city is not a text")}),
        ([{"company_name": "A", "state": True}], {(0, "state is not a text")}),
        ({"city": 5, "businesses": [{"company_name": "A"}, {"company_name": "B", "city": "x"}]}, {(0, "city is not a text")}),
        ({"city": 5, "businesses": [{"phone": "A"}]}, set()),
        ([{"company_name": "911 True", "city": "29 Palms", "state": "true"}], set()),
    ],
)
def test_rejects(spark, value, problems):
    found = rejected(normalise(_documents(spark, value))).collect()
    assert {(r.pos, r.problem) for r in found} == problems

def test_limits_of_the_parser_have_their_own_reason(spark):
    deep = "[" * 1100 + "]" * 1100
    texts = [
        ("long.json", '["' + "x" * 20_000_100 + '"]', "too long"),
        ("deep.json", deep, "too deep"),
        ("deeper.json", '{"a": "]]]\\"]", "b": ' + deep + "}", "too deep"),
        ("wide.json", "[" + "[], " * 2000 + "1]", None),
        ("text.json", '["' + "[" * 3000 + '"]', None),
        ("cut.json", "[[], " * 3, "not json"),
    ]
    rows = spark.createDataFrame([t[:2] for t in texts], "file string, value string")
    assert {r.file: r.problem for r in parse_texts(rows).collect()} == {t[0]: t[2] for t in texts}


def test_kept_texts_equal_the_folder_and_open_new_files_only(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    assert update_texts(spark, str(folder), store).collect() == []

    def write(names, text):
        for name in names:
            (folder / name).write_text(text)

    write(["a.json", "b +1.json", "c_raw.json", "d.txt"], '[{"company_name": "A"}]')
    write(["empty.json"], "")
    first = build_directory(spark, str(folder), str(tmp_path / "o1"), texts_store=store, formats=())
    plain = build_directory(spark, str(folder), str(tmp_path / "o2"), formats=())
    assert first.summary.collect() == plain.summary.collect()
    assert sorted(r.file for r in kept_texts(spark, store).collect()) == ["a.json", "b +1.json", "c_raw.json"]
    # What is kept need not be there any more, and is not looked at again.
    write(["a.json", "b +1.json"], "not read again")
    write(["e.json"], '[{"company_name": "E"}]')
    again = build_directory(spark, str(folder), str(tmp_path / "o3"), texts_store=store, formats=())
    assert tuple(again.summary.first()) == (3, 3, 2, 1)
    assert update_texts(spark, str(folder), store).count() == 4
    assert len(glob.glob(f"{store}/texts/*.parquet")) <= 4


def test_a_file_of_the_table_holds_a_bounded_number_of_texts(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for i in range(25):
        (folder / f"{i}.json").write_text("[]")
    assert update_texts(spark, str(folder), store, files_per_part=4).count() == 25
    counts = spark.read.parquet(f"{store}/texts").groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in counts) <= 4
