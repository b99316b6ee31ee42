"""From a folder of documents to a finished, exported directory."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from placebook.functions.contacts import standard_phone, standard_url
from placebook.operators.dedupe import dedupe, duplicate_numbers
from placebook.operators.normalise import listings, normalise, rejected
from placebook.operators.rollup import by_state, one_row, readable_files
from placebook.sinks.exports import export
from placebook.sources.documents import parse_texts, scan_documents
from placebook.sources.kept_texts import update_texts

# Place of files that a given order does not name: behind all others, by name.
_LAST = 2**62


class Directory(NamedTuple):
    """What a run leaves behind; all frames read finished tables."""

    businesses: DataFrame
    rejected: DataFrame
    by_state: DataFrame
    summary: DataFrame
    output_files: list[str]


def standardise_contacts(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"phone": standard_phone(F.col("phone")), "website": standard_url(F.col("website"))}
    )


def with_file_order(documents: DataFrame, order: DataFrame | None) -> DataFrame:
    """Add ``file_ord`` from a ``(file, file_ord)`` table; without one, names decide.

    A file named twice has its first place.
    """
    if order is None:
        return documents.withColumn("file_ord", F.lit(0).cast("long"))
    places = order.groupBy("file").agg(F.min(F.col("file_ord").cast("long")).alias("file_ord"))
    return documents.join(places, "file", "left").withColumn(
        "file_ord", F.coalesce("file_ord", F.lit(_LAST))
    )


def directory_of(
    documents: DataFrame,
    output_path: str,
    formats: tuple[str, ...] = ("json", "csv"),
    order: DataFrame | None = None,
    standardise: bool = False,
    mode: str = "substring",
) -> Directory:
    """Normalise, dedupe, export and count ``(file, v[, problem])`` documents.

    Two tables are written on the way. Documents are parsed once into ``records``, which
    deduplication reads; exports and roll-ups read ``directory``. The summary is counted while the
    two are written: by the tasks that write, of which each counts once.
    """
    spark = documents.sparkSession
    read, kept = Observation(), Observation()
    rows = normalise(with_file_order(documents, order)).observe(read, readable_files().alias("input_files"))
    rows.write.mode("overwrite").parquet(f"{output_path}/records")
    records = spark.read.parquet(f"{output_path}/records")
    found = listings(records)
    if standardise:
        found = standardise_contacts(found)
    winners = dedupe(found, ["file_ord", "file", "pos"], mode)
    winners.observe(kept, *duplicate_numbers()).write.mode("overwrite").parquet(f"{output_path}/directory")
    businesses = spark.read.parquet(f"{output_path}/directory")
    return Directory(
        businesses=businesses,
        rejected=rejected(records),
        by_state=by_state(businesses),
        summary=one_row(spark, {**read.get, **kept.get}),
        output_files=export(businesses, output_path, formats),
    )


def build_directory(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    pattern: str = "*.json",
    texts_store: str | None = None,
    **options,
) -> Directory:
    """``directory_of`` the documents of a folder.

    With ``texts_store`` the folder's texts are kept there as a table, and only files that are new
    since the last run are opened; see ``update_texts``.
    """
    if texts_store is None:
        documents = scan_documents(spark, input_path, pattern)
    else:
        documents = parse_texts(update_texts(spark, input_path, texts_store, pattern))
    return directory_of(documents, output_path, **options)
