"""Reply files as a stream: incremental directory, progress, and a handler per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placebook.sources.documents import parse_texts, tag_replies
from placebook.sources.kept_texts import text_stream
from placebook.streaming.store import add_batch

#: ``(file, value)``: each arriving file one row.
reply_stream = text_stream


def each_batch(
    stream: DataFrame,
    handler: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Hand over what arrives, batch by batch, to ``handler(batch, batch_id)``.

    Without ``every``, an interval such as ``"1 minute"``, the query ends when all that has
    arrived is handed over. After a failure the last batch comes again with the same id.
    """
    writer = stream.writeStream.outputMode(mode).foreachBatch(handler)
    writer = writer.option("checkpointLocation", checkpoint)
    if every is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()


def keep_directory(
    texts: DataFrame,
    store: str,
    checkpoint: str,
    every: str | None = None,
    prefer: str | None = None,
    **options,
) -> StreamingQuery:
    """Fold the documents of a text stream into the directory at ``store``.

    With ``prefer`` the texts are raw replies, from which the payload is cut first. What cannot
    be used goes to ``store.read_rejected`` with the reason. ``options`` go to ``store.add_batch``.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        documents = parse_texts(batch) if prefer is None else _replied(batch, prefer)
        add_batch(documents, batch_id, store, **options)

    return each_batch(texts, fold, checkpoint, every)


def _replied(texts: DataFrame, prefer: str) -> DataFrame:
    """``(file, v, problem)`` of raw replies."""
    return tag_replies(texts, "value", prefer).select("file", F.col("payload").alias("v"), "problem")


def progress_counts(results: DataFrame) -> DataFrame:
    """One row of done, succeeded and failed tasks; on a stream for complete mode."""
    return results.groupBy().agg(
        F.count("*").alias("done"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def keep_progress(
    results: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Write the running counts of a result stream, one row per batch id, to ``path``."""

    def note(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each_batch(progress_counts(results), note, checkpoint, every, mode="complete")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The newest counts."""
    return spark.read.parquet(path).orderBy(F.desc("batch")).limit(1).drop("batch")
