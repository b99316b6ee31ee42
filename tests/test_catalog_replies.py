"""Replies of the catalog hold whole documents."""

import os

import pytest
from pyspark.sql import functions as F

from placebook.catalog.texts import replies
from placebook.session import prepare

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_every_document_is_read_whole_in_a_reply(spark):
    prepare(spark)
    said = replies(spark, DATA).where("length(reply) > 0")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert docs.where("text is null or length(text) = 0").count() == 0
    unread = docs.join(F.broadcast(said), F.expr("contains(reply, text)"), "left_anti")
    assert unread.count() == 0
    assert said.where("event_id % 12 = 7").join(docs, F.expr("contains(reply, text)"), "left_anti").count() == 0
