"""From raw documents to packed training sequences, in stages that are written and read again.

Quality rules drop documents; near-duplicate search leaves one document of each group;
decontamination drops documents that hold benchmark passages; secrets are masked in place; packing
cuts what is left into sequences. Every stage takes all rows that the one before it kept, and all
but the last return the columns of ``documents``. What a stage does with nulls, empty and very long
texts, repeated rows, empty tables and further columns is told by its operator.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from placebook.llm import blob_ledger, compression_bands, forest_join, hierarchical_packing, winnowing
from placebook.llm.shared import fresh_folder, kept, read, read_if_there

END = 2

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_if_there(spark, sf_dir, "labels", "doc_id long, quality int")
    return compression_bands.accepted(docs, compression_bands.fitted(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return forest_join.survivors(docs, fresh_folder(spark, "forest"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnowing.clean(docs, read(spark, sf_dir, "benchmark"), fresh_folder(spark, "winnowing"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return blob_ledger.masked(docs, fresh_folder(spark, "ledger"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hierarchical_packing.packed_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), END)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: Neither zstandard ratios nor token ids can be had in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage returns, from the ``documents`` of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "pipeline")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
