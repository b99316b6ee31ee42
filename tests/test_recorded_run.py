"""A recorded run, if there is one: RECORDED_RUN names a folder with ``outputs`` (replies and
payloads) and ``aggregated/results.csv``."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from placebook.functions.payload import balanced_json, reply_json
from placebook.plans.directory import build_directory, directory_of
from placebook.sources.documents import scan_raw_replies

RUN = os.environ.get("RECORDED_RUN")
pytestmark = pytest.mark.skipif(not RUN, reason="RECORDED_RUN is not set")

# The order in which the run's files were read, as its result shows.
ORDER = [
    "TX_Dallas", "CA_LosAngeles", "TX_Houston", "CA_Sacramento", "TX_FortWorth", "TX_SanAntonio",
    "TX_ElPaso", "CA_SanDiego", "CA_SanJose", "CA_SanFrancisco", "CA_Fresno", "TX_Austin",
]


@pytest.mark.parametrize("rule", [reply_json, balanced_json])
def test_payloads(spark, rule):
    replies = scan_raw_replies(spark, f"{RUN}/outputs").withColumn("j", F.to_json(rule("value")))
    got = {r.task_id: json.loads(r.j) for r in replies.collect()}
    saved = {os.path.basename(p)[:-5]: json.load(open(p)) for p in glob.glob(f"{RUN}/outputs/*.json")}
    assert got == saved and len(got) == 12


def test_directory(spark, tmp_path):
    rows = [(f"search_{name}.json", i) for i, name in enumerate(ORDER)]
    order = spark.createDataFrame(rows, "file string, file_ord int")
    built = build_directory(spark, f"{RUN}/outputs", str(tmp_path), order=order)
    assert tuple(built.summary.first()) == (12, 126, 110, 16)
    parts = [open(p, newline="").read() for p in sorted(glob.glob(f"{tmp_path}/results.csv/part-*"))]
    with open(f"{RUN}/aggregated/results.csv", newline="") as saved:
        assert "".join(parts) == saved.read()


def test_other_orders_and_preferences(spark, tmp_path):
    by_name = build_directory(spark, f"{RUN}/outputs", str(tmp_path / "a"), formats=())
    winners = {r.company_name: r.source_task for r in by_name.businesses.collect()}
    assert len(winners) == 110
    assert winners["Royal Ambulance"] == "search_CA_SanFrancisco.json"
    assert winners["Acadian Ambulance Service"] == "search_TX_Austin.json"
    replies = scan_raw_replies(spark, f"{RUN}/outputs")
    documents = replies.select(
        F.concat("task_id", F.lit(".json")).alias("file"), reply_json("value", "outermost").alias("v")
    )
    whole = directory_of(documents, str(tmp_path / "b"), formats=())
    assert tuple(whole.summary.first()) == (12, 126, 126, 0)
    assert [tuple(r) for r in whole.by_state.collect()] == [("CA", 6, 61), ("TX", 6, 65)]
