"""Queries of the operators over the given tables, with production parameters and no limits."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from placebook.llm import (
    bit_sliced_resampling,
    blob_ledger,
    compression_bands,
    elias_fano_ids,
    forest_join,
    hierarchical_packing,
    kneser_ney,
    oracles,
    recompression,
    redirect_equivalence,
    rotated_codes,
    string_kernel_language,
    virtual_slots,
    winnowing,
)
from placebook.llm.shared import fresh_folder, read, read_if_there

END = 2
LABELS = "doc_id long, quality int"

Query = Callable[[SparkSession, str], DataFrame]


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces, packed into sequences of 512 to 4096 ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return hierarchical_packing.packed_pieces(read(spark, sf_dir, "documents"), path, END)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a benchmark passage, and the items they come from."""
    docs, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return winnowing.decontaminated(docs, benchmark).drop("text_key")


def op3_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return redirect_equivalence.judged(read(spark, sf_dir, "pages"), fresh_folder(spark, "aliases")).drop("alias_group")


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of near equal bytes."""
    return virtual_slots.sharded(read(spark, sf_dir, "documents"), 24)


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 words that an earlier one has."""
    kept = recompression.without_repeats(read(spark, sf_dir, "documents"), fresh_folder(spark, "repeats"), with_text=False)
    return kept.drop("kept_text")


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, compression ratio and verdict of every document, by limits from the labels beside them."""
    docs, labels = read(spark, sf_dir, "documents"), read_if_there(spark, sf_dir, "labels", LABELS)
    return compression_bands.judged(docs, compression_bands.fitted(docs, labels))


def op7_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each distinct text scanned once."""
    return blob_ledger.secrets(read(spark, sf_dir, "documents"), fresh_folder(spark, "ledger"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of the training documents."""
    return kneser_ney.scored(read(spark, sf_dir, "documents"), fresh_folder(spark, "model"))


def op9_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near-duplicates and number of links of every document."""
    found = forest_join.joined(read(spark, sf_dir, "documents"), fresh_folder(spark, "forest"))
    return found.drop("text_key", "class_key")


def op10_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as ids with Elias-Fano boundaries, and read back."""
    tokens = elias_fano_ids.Tokens(public_tokenizers.path("byte_bpe_50k.json"), END)
    docs, folder = read(spark, sf_dir, "documents"), fresh_folder(spark, "ids")
    return elias_fano_ids.read_back(docs, folder, elias_fano_ids.write(docs, folder, tokens))


def op11_bit_sliced_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw of a tenth that looks like the benchmark."""
    docs, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return bit_sliced_resampling.resampled(docs, benchmark, fresh_folder(spark, "resampled")).drop("n_words")


def op12_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    return string_kernel_language.identified(read(spark, sf_dir, "documents"))


def op13_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and each of its positives."""
    return rotated_codes.mined(read(spark, sf_dir, "embeddings"), fresh_folder(spark, "negatives"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_hierarchical_packing,
        op2_winnowing,
        op3_redirect_equivalence,
        op4_virtual_slots,
        op5_recompression,
        op6_compression_bands,
        op7_blob_ledger,
        op8_kneser_ney,
        op9_forest_join,
        op10_elias_fano_ids,
        op11_bit_sliced_resampling,
        op12_string_kernel_language,
        op13_rotated_codes,
    )
}

#: SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op2_winnowing": oracles.OP2,
    "op3_redirect_equivalence": oracles.OP3,
    "op5_recompression": oracles.OP5,
    "op7_blob_ledger": oracles.OP7,
    "op9_forest_join": oracles.OP9,
    "op11_bit_sliced_resampling": oracles.OP11,
    "op13_rotated_codes": oracles.OP13,
}
