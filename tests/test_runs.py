"""Task runs, statistics, sinks and whole runs."""

import csv
import glob
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from placebook.fixed_values import CSV_COLUMNS
from placebook.operators.dedupe import dedupe
from placebook.operators.enrich import kept_results, run_kept, run_tasks, save_results, with_payload
from placebook.operators.normalise import listings, normalise
from placebook.operators.rollup import failed_tasks, run_stats
from placebook.plans.directory import build_directory, directory_of
from placebook.plans.research import run_research
from placebook.sinks.exports import export, export_csv, export_json_document, read_csv, read_json
from placebook.sinks.replies import (
    read_parsed_replies,
    read_raw_replies,
    read_reply_documents,
    read_unusable_replies,
    replayed,
    save_replies,
)
from placebook.sources.targets import TARGET_SCHEMA
from placebook.streaming.replies import keep_directory
from placebook.streaming.store import read_rejected


def _work():
    def work(task):
        if task["prompt"] is None:
            raise ValueError("no prompt")
        if task["prompt"] == "crash":
            raise KeyError
        return task["prompt"].upper()

    return work


def test_every_task_has_one_outcome(spark, tmp_path):
    tasks = spark.createDataFrame([("a", "x"), ("b", None), ("c", "crash")], "task_id string, prompt string")
    kept = save_results(run_tasks(tasks, _work(), concurrency=2), str(tmp_path / "r"))
    got = {r.task_id: (r.success, r.output, r.error) for r in kept.collect()}
    assert got == {"a": (True, "X", None), "b": (False, None, "no prompt"), "c": (False, None, "KeyError")}
    assert kept.where("execution_time >= 0").count() == 3
    assert {r.task_id for r in failed_tasks(kept).collect()} == {"b", "c"}
    assert [r.task_id for r in with_payload(kept).collect()] == ["a"]


def test_whole_numbers_and_nulls_reach_the_work(spark, tmp_path):
    def work(task):
        return repr((task["n"], task["m"], task["terms"]))

    tasks = spark.createDataFrame([("a", 1, None, ["x"]), ("b", None, 2, None)], "task_id string, n int, m long, terms array<string>")
    kept = save_results(run_tasks(tasks, work, concurrency=1), str(tmp_path / "r"))
    assert {r.task_id: r.output for r in kept.collect()} == {"a": "(1, None, ['x'])", "b": "(None, 2, None)"}


def _counted(calls, fails):
    """Work that notes every call; ``fails(task, times)`` says what happens before it answers."""

    def work(task):
        name = f"{calls}/{task['task_id']}"
        times = len(glob.glob(f"{name}-*"))
        open(f"{name}-{times}", "w").close()
        fails(task, times)
        return "done"

    return work


def _calls(calls):
    names = [os.path.basename(p).rsplit("-", 1)[0] for p in glob.glob(f"{calls}/*")]
    return {name: names.count(name) for name in names}


def test_a_run_ended_inside_a_slice_loses_that_slice_only(spark, tmp_path):
    calls, path = str(tmp_path / "calls"), str(tmp_path / "r")
    os.mkdir(calls)

    def fails(task, times):
        if task["task_id"] == "t17" and not times:
            os._exit(1)  # ends the worker, and with it the run

    work = _counted(calls, fails)
    tasks = spark.range(60).select(F.concat(F.lit("t"), "id").alias("task_id"), F.lit(None).cast("string").alias("note"))
    with pytest.raises(Exception):
        run_kept(tasks, work, 2, path, slice_rows=8)
    slices = {r.file: r.ids for r in spark.read.parquet(f"{path}/attempt=1/tasks").groupBy(F.input_file_name().alias("file")).agg(F.collect_set("task_id").alias("ids")).collect()}
    assert len(slices) >= 6
    broken = next(set(ids) for ids in slices.values() if "t17" in ids)
    finished = {r.task_id for r in kept_results(spark, path, 1).collect()}
    assert "t17" not in finished and finished.isdisjoint(broken)
    kept = run_kept(tasks, work, 2, path, slice_rows=8)
    assert {r.task_key: r.success for r in kept.collect()} == {f"t{i}": True for i in range(60)} and kept.count() == 60
    twice = {name for name, times in _calls(calls).items() if times > 1}
    assert twice <= broken and "t17" in twice
    before = _calls(calls)
    assert run_kept(tasks, work, 2, path, slice_rows=8).count() == 60 and _calls(calls) == before


def test_failed_tasks_are_asked_again_on_request(spark, tmp_path):
    calls, path = str(tmp_path / "calls"), str(tmp_path / "r")
    os.mkdir(calls)

    def fails(task, times):
        assert task["attempt"] == times + 1
        if times < int(task["task_id"]) % 4:
            raise TimeoutError(f"try {times}")

    work, tasks = _counted(calls, fails), spark.range(20).select(F.col("id").cast("string").alias("task_id"))

    def outcomes(kept):
        return {int(r.task_id): (r.success, r.error, r.attempt) for r in kept.collect()}

    first = run_kept(tasks, work, 2, path)
    assert outcomes(first) == {i: (i % 4 == 0, "try 0" if i % 4 else None, 1) for i in range(20)}
    # The tasks are those of the first call, even if another call would plan others.
    last = run_kept(tasks.where("false"), work, 2, path, attempts=3)
    assert outcomes(last) == {i: (i % 4 < 3, None if i % 4 < 3 else "try 2", min(i % 4, 2) + 1) for i in range(20)}
    assert _calls(calls) == {str(i): min(i % 4, 2) + 1 for i in range(20)} and last.count() == 20


def test_tasks_without_a_key_of_their_own_are_refused(spark, tmp_path):
    for ids, named in ((["a", "b", "a"], "'a'"), (["a", None], "None")):
        tasks = spark.createDataFrame([(i,) for i in ids], "task_id string")
        with pytest.raises(ValueError, match=f"of their own: .*{named}"):
            run_kept(tasks, lambda task: "x", 2, str(tmp_path / "r"))
    assert run_kept(tasks.where("false"), lambda task: "x", 2, str(tmp_path / "none")).count() == 0


def test_stats(spark):
    df = spark.createDataFrame([(True, 1.0), (False, 2.0), (True, 6.0)], "success boolean, execution_time double")
    row = run_stats(df).first()
    assert tuple(row) == (3, 2, 1, pytest.approx(200 / 3), 9.0, 3.0)
    assert tuple(run_stats(df.where("false")).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def _results(spark, **outputs):
    df = spark.createDataFrame(list(outputs.items()), "task_id string, output string")
    return df.withColumn("success", F.lit(True))


def test_saved_replies(spark, tmp_path):
    path = str(tmp_path)
    first = {"a": '[{"company_name": "A"}]', "b": "prose", "c": "[]", "d": "null", "e": '{"x": 1}', "f": "0"}
    save_replies(_results(spark, **first), path, "1")
    save_replies(_results(spark, a="nothing found", e='{"x": 2}'), path, "2")
    save_replies(_results(spark, a="nothing found", e='{"x": 3}'), path, "2")
    raw = {r.task_id: r.value for r in read_raw_replies(spark, path).collect()}
    assert raw == first | {"a": "nothing found", "e": '{"x": 3}'}
    parsed = read_parsed_replies(spark, path).select("file", F.to_json("v").alias("j")).collect()
    # A reply without a payload leaves the payload of an earlier run in place.
    assert {r.file: r.j for r in parsed} == {"a.json": '[{"company_name":"A"}]', "e.json": '{"x":3}'}
    unusable = {(r.task_key, r.problem) for r in read_unusable_replies(spark, path).collect()}
    nothing = {(key, "nothing in it") for key in "cdf"}
    assert unusable == nothing | {("a", "not json"), ("b", "not json")}
    assert {r.task_key for r in read_unusable_replies(spark, path, "2").collect()} == {"a"}
    documents = {r.file: (r.j, r.problem) for r in read_reply_documents(spark, path).select("file", F.to_json("v").alias("j"), "problem").collect()}
    assert documents["a.json"] == ('[{"company_name":"A"}]', None) and documents["c.json"] == (None, "nothing in it")
    assert len(documents) == 6


REASONS = {
    "fine": ('Here: {"company_name": "A"}', None),
    "nul": (None, "empty"),
    "none": ("", "empty"),
    "prose": ("I found nothing [yet].", "not json"),
    "list": ("Sorry: []", "nothing in it"),
    "zero": (" 0 ", "nothing in it"),
    "deep": ("Found: " + "[" * 1200 + "]" * 1200, "too deep"),
    "flat": ("[ " * 1200 + "Found", "not json"),
}


def test_runs_replays_and_streams_give_the_same_reasons(spark, tmp_path):
    want = {(f"{key}.json", problem) for key, (_, problem) in REASONS.items() if problem}
    want = (want - {("flat.json", "not json")}) | {("flat.json", "too deep")}  # opens 1,200 levels, whatever follows
    texts = spark.createDataFrame([(key, text) for key, (text, _) in REASONS.items()], "task_id string, value string")
    assert {(r.file, r.problem) for r in replayed(texts).where("problem IS NOT NULL").collect()} == want
    save_replies(texts.select("task_id", F.lit(True).alias("success"), F.col("value").alias("output")), f"{tmp_path}/r", "1")
    kept = directory_of(read_reply_documents(spark, f"{tmp_path}/r", "1"), f"{tmp_path}/d", ())
    assert {(r.file, r.problem) for r in kept.rejected.collect()} == want
    assert tuple(kept.summary.first()) == (1, 1, 1, 0)
    named = texts.select(F.concat("task_id", F.lit(".json")).alias("file"), "value")
    named.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(named.schema).parquet(f"{tmp_path}/in")
    keep_directory(stream, f"{tmp_path}/s", f"{tmp_path}/c", prefer="array").awaitTermination()
    assert {(r.file, r.problem) for r in read_rejected(spark, f"{tmp_path}/s").collect()} == want


AWKWARD = [
    {"company_name": 'Quote "Q", Inc', "city": " Waco ", "address": "1 Main\nSuite 2\r\nRear", "email": None},
    {"company_name": "Ünï 😀 \x7f", "phone": "", "website": "a,b"},
    {"company_name": "# not a comment", "address": "back\\slash", "phone": "'"},
]
PROFILE = {"company_name": "P", "location": {"city": "Waco"}, "business_details": {"fleet_size": 3}, "online_presence": None}


def _directory(spark):
    rows = [("a.json", json.dumps(AWKWARD)), ("b.json", json.dumps(PROFILE))]
    documents = spark.createDataFrame(rows, "file string, value string").select("file", F.parse_json("value").alias("v"))
    return dedupe(listings(normalise(documents)), ["file", "pos"])


def _joined(path):
    return "".join(open(p, newline="").read() for p in sorted(glob.glob(f"{path}/part-*")))


def _expected(spark):
    rows = _directory(spark).orderBy("first_seen").collect()
    return [{name: r[name] for name in CSV_COLUMNS} for r in rows]


def test_csv_is_as_python_writes_it(spark, tmp_path):
    export_csv(_directory(spark), str(tmp_path / "c"))
    text = io.StringIO(newline="")
    writer = csv.DictWriter(text, CSV_COLUMNS)
    writer.writeheader()
    writer.writerows(_expected(spark))
    assert _joined(tmp_path / "c") == text.getvalue()
    # Spark's reader gives every line end inside a value as a line feed.
    back = [tuple(r) for r in read_csv(spark, str(tmp_path / "c")).collect()]
    sent = [tuple((v or "").replace("\r\n", "\n") or None for v in row.values()) for row in _expected(spark)]
    assert sorted(back, key=str) == sorted(sent, key=str)


def test_json_exports(spark, tmp_path):
    written = export(_directory(spark), str(tmp_path), ("json",))
    assert written == [f"{tmp_path}/results.json"]
    businesses, manifest = read_json(spark, written[0])
    assert manifest.first().total_records == 4
    lines = [json.loads(line) for line in _joined(f"{written[0]}/businesses").splitlines()]
    expected = _expected(spark)
    expected[3] |= {"business_details": {"fleet_size": 3}, "key_contacts": None, "online_presence": None}
    assert lines == expected
    assert businesses.where("company_name = 'P'").first().business_details.toPython() == {"fleet_size": 3}
    with pytest.raises(ValueError):
        export(_directory(spark), str(tmp_path), ("xml",))


def test_json_document_is_one_document(spark, tmp_path):
    plain = _directory(spark).where("extra IS NULL")
    export_json_document(plain, str(tmp_path / "d"))
    text = _joined(tmp_path / "d")
    document = json.loads(text)
    assert document["total_records"] == 3 and document["businesses"] == _expected(spark)[:3]
    assert text == json.dumps(document, indent=2) + "\n"
    export_json_document(_directory(spark), str(tmp_path / "e"))
    assert json.loads(_joined(tmp_path / "e"))["businesses"][3]["business_details"] == {"fleet_size": 3}
    export_json_document(plain.where("false"), str(tmp_path / "f"))
    assert json.loads(_joined(tmp_path / "f"))["businesses"] == []


def _folder(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    one = {"company_name": "Acme Inc", "phone": "555-123-4567"}
    better = {"company_name": "ACME", "phone": "5551234567", "email": "e", "website": "acme.example"}
    (folder / "a.json").write_text(json.dumps([one, {"company_name": "Solo"}]))
    (folder / "b.json").write_text(json.dumps([better, one]))
    (folder / "c.json").write_text("{cut")
    (folder / "d.json").write_text("[]")
    return str(folder)


def test_build_directory(spark, tmp_path):
    built = build_directory(spark, _folder(tmp_path), str(tmp_path / "out"), standardise=True)
    assert tuple(built.summary.first()) == (3, 4, 2, 2)
    rows = built.businesses.orderBy("first_seen").collect()
    assert [(r.company_name, r.phone, r.website, r.source_task, r.sightings) for r in rows] == [
        ("ACME", "(555) 123-4567", "https://acme.example", "b.json", 3), ("Solo", None, None, "a.json", 1),
    ]
    assert [tuple(r) for r in built.rejected.collect()] == [("c.json", 0, "not json")]
    assert [tuple(r) for r in built.by_state.collect()] == [("Unknown", 0, 2)]
    assert [p.rsplit("/", 1)[1] for p in built.output_files] == ["results.json", "results.csv"]


def test_file_order_decides_ties(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in "abc":
        (folder / f"{name}.json").write_text(json.dumps([{"company_name": "Acme", "phone": name}]))
    order = spark.createDataFrame([("c.json", 1), ("b.json", 2), ("c.json", 3)], "file string, file_ord int")
    by_name = build_directory(spark, str(folder), str(tmp_path / "o1"), formats=())
    by_order = build_directory(spark, str(folder), str(tmp_path / "o2"), formats=("csv",), order=order)
    assert by_name.businesses.first().phone == "a"
    assert by_order.businesses.first().phone == "c"
    assert tuple(by_order.summary.first()) == (3, 3, 1, 2)
    assert by_order.output_files == [f"{tmp_path}/o2/results.csv"]


def _searcher():
    def work(task):
        if task["city"] == "Dallas":
            raise TimeoutError("timed out")
        found = [{"company_name": "Everywhere LLC"}, {"company_name": f"{task['city']} Shop", "phone": "1"}]
        envelope = {"task_id": task["task_id"], "city": task["city"], "state": task["state"], "businesses": found}
        assert task["prompt"].startswith("Search well\n\n---\n\n@web \nSearch for businesses")
        return f"I searched.\n{json.dumps(envelope)}"

    return work


def test_research(spark, tmp_path):
    requests = spark.createDataFrame([("t", "TX", "EMS", None, None), ("bad", "TX,ZZ", None, None, None)], TARGET_SCHEMA)
    instructions = spark.createDataFrame([("city_search", "Search well")], "task_type string, text string")
    run = run_research(requests, instructions, _searcher(), str(tmp_path / "a"), "r1", concurrency=2)
    row = run.summary.first()
    assert (row.states_researched, row.tasks_generated, row.tasks_executed) == (["TX"], 8, 8)
    assert (row.tasks_successful, row.tasks_failed) == (7, 1)
    # The list inside the envelope is taken, so places are lost and one name is one business.
    assert tuple(row.aggregation) == (7, 14, 8, 6)
    assert [tuple(r) for r in run.rejected.collect()] == [("bad", "ZZ", "unknown state")]
    assert [r.task_id for r in run.failed.collect()] == ["search_TX_Dallas"]
    whole = run_research(
        requests, instructions, _searcher(), str(tmp_path / "b"), "r1", concurrency=2, prefer="outermost"
    )
    assert tuple(whole.summary.first().aggregation) == (7, 14, 14, 0)
    short = run_research(
        requests, instructions, _searcher(), str(tmp_path / "c"), "r1", skip_aggregation=True
    )
    assert short.directory is None and short.summary.first().aggregation is None


def test_targets_share_cities_and_lose_nothing(spark, tmp_path):
    requests = spark.createDataFrame([("a", "TX", "EMS", None, None), ("b", "TX,TX,WA", "Law", None, None)], TARGET_SCHEMA)
    none = spark.createDataFrame([], "task_type string, text string")

    def work(task):
        found = [{"company_name": f"{task['target_id']} {task['state_pos']}"}]
        return json.dumps({"city": task["city"], "state": task["state"], "businesses": found})

    run = run_research(requests, none, work, str(tmp_path / "a"), "r", concurrency=2, prefer="outermost", formats=())
    assert tuple(run.summary.first().aggregation) == (24, 24, 24, 0)
    assert [tuple(r) for r in run.rejected.collect()] == [("b", "WA", "no cities known")]
    again = run_research(requests, none, work, str(tmp_path / "a"), "s", concurrency=2, prefer="outermost", formats=())
    assert tuple(again.summary.first().aggregation) == (24, 24, 24, 0)
    with pytest.raises(ValueError, match="twice"):
        run_research(requests.union(requests), none, work, str(tmp_path / "b"), "r")


def test_every_request_has_a_task_or_a_reason(spark, tmp_path):
    plans = {
        "prose": "I cannot plan this.",
        "empty": "[]",
        "object": '{"city": "Waco"}',
        "strays": "[1, null]",
        "part": '[{"city": "Waco", "state": " tx"}, 7]',
        "open": '[{"task_type": "company_research", "company_name": "A"}]',
    }

    def work(task):
        if task["task_type"] == "planning":
            if task["target_id"] == "late":
                raise TimeoutError("timed out")
            return plans[task["target_id"]]
        return "[]" if task["target_id"] == "open" else '[{"company_name": "B"}]'

    rows = [(name, "TX,CA", None, None, None) for name in [*plans, "late"]] + [("bad", "ZZ", None, None, None)]
    requests = spark.createDataFrame(rows, TARGET_SCHEMA)
    none = spark.createDataFrame([], "task_type string, text string")
    run = run_research(requests, none, work, str(tmp_path), "r", concurrency=2, ask_planner=True, formats=())
    got = {(r.target_id, r.state, r.reason) for r in run.rejected.collect()}
    stray = ("task is not an object", "task for this state")
    assert got == {
        ("prose", None, "no task in plan"), ("empty", None, "no task in plan"), ("object", None, "plan is not a list"),
        ("strays", None, stray[0]), ("part", None, stray[0]), ("part", "CA", f"no {stray[1]}"),
        ("late", None, "no plan: timed out"), ("bad", "ZZ", "unknown state"),
    }
    assert [(r.task_id, r.problem) for r in run.unusable.collect()] == [("task_0", "nothing in it")]
    assert [r.problem for r in run.directory.rejected.collect()] == ["nothing in it"]
    assert tuple(run.summary.first().aggregation) == (1, 1, 1, 0)
