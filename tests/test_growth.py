"""Larger tables make larger batches and files, not more of them, and texts are not moved to be chosen."""

import glob

import pytest
from pyspark.sql import functions as F

from placebook import catalog
from placebook.operators import enrich
from placebook.operators.enrich import run_kept
from placebook.sinks.replies import read_parsed_replies, read_raw_replies, read_reply_documents, save_replies
from placebook.sources.kept_texts import update_texts


def _folders(spark, pattern):
    return set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/{pattern}"))


def _echo():
    return lambda task: task["task_id"]


def test_a_run_of_many_tasks_has_few_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(enrich, "MOST_SLICES", 3, raising=False)
    tasks = spark.range(12_000).select(F.concat(F.lit("t"), "id").alias("task_id"))
    kept = run_kept(tasks, _echo(), 2, f"{tmp_path}/r")
    assert len(glob.glob(f"{tmp_path}/r/attempt=1/results/slice=*")) <= 3
    assert kept.count() == 12_000 and kept.where("output = task_key").select("task_key").distinct().count() == 12_000


def test_results_are_read_once_to_save_replies(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    results = spark.range(50).selectExpr("CAST(id AS STRING) AS task_id", "true AS success", "concat('[', id + 1, ']') AS output")
    save_replies(results.mapInArrow(noted, results.schema), str(tmp_path), "01")
    assert read.value == 50
    assert read_raw_replies(spark, str(tmp_path)).count() == read_parsed_replies(spark, str(tmp_path)).count() == 50


@pytest.mark.parametrize("groups", [1, 3])
def test_replies_of_several_runs_are_chosen_by_place(spark, tmp_path, groups):
    """Files of several bitmaps, keys twice in a run and null keys; no text goes through a shuffle."""
    def saved(rows, run_id):
        save_replies(rows.select(F.expr("IF(id = 7, NULL, CAST(id AS STRING))").alias("task_id"), F.lit(True).alias("success"), F.concat(F.lit(f'["{run_id}-'), "id", F.lit('"]')).alias("output")), str(tmp_path), run_id)

    saved(spark.range(0, 70_000, 1, groups).unionAll(spark.range(5)), "1")
    saved(spark.range(0, 70_000, 3, groups).where("id > 9"), "2")
    want = [(f"{i}", f'["{2 if i > 9 and i % 3 == 0 else 1}-{i}"]') for i in [*range(70_000), *range(5)] if i != 7]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chosen = read_raw_replies(spark, str(tmp_path))
        assert chosen.columns == ["task_key", "task_id", "value", "saved_at", "run_id"]
        assert sorted((r.task_key, r.value) for r in chosen.collect()) == sorted(want)
        plan = chosen._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan.split("SortMergeJoin")[0]
        parsed = read_parsed_replies(spark, str(tmp_path)).select("file", F.to_json("v").alias("j")).collect()
        assert sorted((r.file.removesuffix(".json"), r.j) for r in parsed) == sorted(want)
        assert read_reply_documents(spark, str(tmp_path)).where("problem IS NULL").count() == len(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _given(spark, folder, **tables):
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_more_files_come_in_larger_batches(spark, tmp_path):
    given = {name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("supplier", "nation", "region")}
    one = given["supplier"].limit(1).drop("s_suppkey")
    more = spark.range(1, 1601).withColumnRenamed("id", "s_suppkey").join(F.broadcast(one)).select(*given["supplier"].columns)
    where, seen = _given(spark, tmp_path, **given | {"supplier": more}), _folders(spark, "copied-*/batch=*")
    assert catalog.queries()["stream_ingest"](spark, where).first().files == 1600
    assert len(_folders(spark, "copied-*/batch=*") - seen) <= 26


def test_more_results_come_in_larger_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(100).drop("event_id")
    many = spark.range(0, 2000, 1, 1).join(F.broadcast(events)).withColumn("event_id", F.monotonically_increasing_id())
    where, seen = _given(spark, tmp_path, events=many), _folders(spark, "counts-*/batch=*")
    assert catalog.queries()["stream_progress"](spark, where).first().done == 200_000
    assert len(_folders(spark, "counts-*/batch=*") - seen) <= 17


def test_many_small_files_are_kept_in_few(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(1200):
        (tmp_path / "in" / f"{i}.json").write_text(f"[{i}]")
    texts = update_texts(spark, f"{tmp_path}/in", f"{tmp_path}/store")
    assert texts.select("file", "value").distinct().count() == 1200
    assert len(glob.glob(f"{tmp_path}/store/texts/part-*")) <= 16
