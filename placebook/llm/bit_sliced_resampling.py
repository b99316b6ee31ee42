"""Importance resampling towards a target: documents that look like the target are drawn more often.

Features are runs of 1 to n words, hashed into a fixed number of buckets. A bucket's gain says how
much more often the target holds it than the corpus does. A document's weight is the mean gain of its
features, and the draw takes the highest sums of weight and Gumbel noise, which samples without
replacement in proportion to the exponential of the weights. The noise is a hash of the id, so that
a draw can be repeated.

Weights are summed bit by bit. The counts of a document become planes of one bit per bucket: plane p
says which buckets have bit p in their count. The gains become planes as well, in two's complement,
so the highest plane counts as negative. The sum of count times gain is then the sum over pairs of
planes of 2 to the power of both numbers times the bits that are set in both: whole numbers, hence
the same in any order and on any executor.

Corpus counts cover all documents. Each task sends one sum per bucket, and the driver sees one row
per bucket and one per score value; both numbers are fixed (a score lies between the logarithms of
64-bit counts). The drawn rows are ranked by a range partition whose last key is a row number, so a
third of all rows with one id is split as well.

Words are runs of digits, a-z and non-ASCII characters after A-Z are made small. A null or empty text
has no features and weight 0, and so has a text without words. A null doc_id has the noise of an
empty one and comes last among ties. Texts are taken whole: slices of a few megabytes are cut between
texts, and a longer text is a slice of its own. Repeated rows count, and are ranked, one by one. Only
doc_id and text are read. An empty corpus gives an empty result; an empty target has no counts, so
that rare buckets gain.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placebook.llm.shared import kept
from placebook.llm.words import LOWER, Texts, named, runs, slices, texts

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Draw:
    """``n``: longest run of words that is a feature. Of the documents with ``min_words`` words,
    ``percent`` percent are drawn; ``seed`` starts the text that the noise is hashed from."""

    n: int = 1
    buckets: int = 10_000
    seed: str = "2024"
    min_words: int = 20
    percent: int = 10


def features(given: Texts, draw: Draw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every feature its text and its bucket; of every text its number of words."""
    data = LOWER[given.data]
    inside = WORD[data]
    starts, ends, bounds = runs(inside, given.bounds)
    sizes, n_words = ends - starts, np.diff(bounds)
    owner = np.repeat(np.arange(len(given)), n_words)
    which, known = named(data[inside], sizes)
    crc = np.array([zlib.crc32(word) for word in known.to_pylist()], np.int64)
    owners, values = [owner], [crc[which] if len(which) else np.zeros(0, np.int64)]
    if draw.n > 1 and len(sizes):
        at = np.append(0, np.cumsum(sizes + 1))  # each word with a space behind it
        joined = np.full(at[-1], 0x20, np.uint8)
        joined[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = data[inside]
        view = memoryview(joined)
        for k in range(2, draw.n + 1):
            first = np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :])
            owners.append(owner[first])
            spans = zip(at[first].tolist(), (at[first + k] - 1).tolist(), strict=True)
            values.append(np.array([zlib.crc32(view[a:b]) for a, b in spans], np.int64))
    return np.concatenate(owners), np.concatenate(values) % draw.buckets, n_words


def bucket_counts(docs: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """(bucket, n) over all texts; a task sends at most one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draw.buckets, np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(features(texts(batch.column("text")), draw)[1], minlength=draw.buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, draw: Draw = Draw()) -> np.ndarray:
    """1000 times the logarithm of how much more often the target has each bucket, rounded down."""

    def counts(rows: DataFrame) -> np.ndarray:
        out = np.zeros(draw.buckets, np.int64)
        for row in bucket_counts(rows, draw).collect():  # at most one row per bucket
            out[row.bucket] = row.n
        return out

    s, t = counts(corpus), counts(target)
    total_s, total_t = float(s.sum() + draw.buckets), float(t.sum() + draw.buckets)
    pairs = zip(s.tolist(), t.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((b + 1.0) * total_s / ((a + 1.0) * total_t))) for a, b in pairs], np.int64)


def bit_rows(row: np.ndarray, bit: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Rows of 64-bit words in which the named bits are set."""
    flags = np.zeros((shape[0], -(-shape[1] // 64) * 64), bool)
    flags[row, bit] = True
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(factor, bits) per plane of the gains in two's complement."""
    bits = int(max(gain.max(), -gain.min() - 1, 0)).bit_length()
    planes = []
    for q in range(bits + 1):
        at = np.flatnonzero(gain >> q & 1)
        if len(at):
            planes.append((-(1 << q) if q == bits else 1 << q, bit_rows(np.zeros(len(at), np.int64), at, (1, len(gain)))[0]))
    return planes


def weighted_sums(owner: np.ndarray, bucket: np.ndarray, count: int, planes: list[tuple[int, np.ndarray]], buckets: int) -> np.ndarray:
    """Sum of gains over the features of each of ``count`` texts."""
    out = np.zeros(count, np.int64)
    key, times = np.unique(owner * buckets + bucket, return_counts=True)
    row, bit = np.divmod(key, buckets)
    for p in range(int(times.max()).bit_length() if len(times) else 0):
        has = np.flatnonzero(times >> p & 1)
        rows, local = np.unique(row[has], return_inverse=True)
        for lo in range(0, len(rows), 512):  # texts whose planes are in memory at once
            part = (local >= lo) & (local < lo + 512)
            own = bit_rows(local[part] - lo, bit[has][part], (min(512, len(rows) - lo), buckets))
            for factor, gain in planes:
                set_in_both = np.bitwise_count(own & gain).sum(axis=1, dtype=np.int64)
                out[rows[lo : lo + 512]] += (factor << p) * set_in_both
    return out


def noise(doc_id: int | None, seed: str) -> int:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def scored(docs: DataFrame, gain: np.ndarray, draw: Draw = Draw()) -> DataFrame:
    """Weight and score of every row of ``docs`` (doc_id, text), in place: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = gain_planes(gain)
        for batch in slices(batches, "text"):
            owner, bucket, n_words = features(texts(batch.column("text")), draw)
            n_features = np.bincount(owner, minlength=batch.num_rows)
            weight = weighted_sums(owner, bucket, batch.num_rows, planes, draw.buckets) // np.maximum(n_features, 1)
            score = weight + np.array([noise(i, draw.seed) for i in batch.column("doc_id").to_pylist()], np.int64)
            columns = [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n_words, n_features, weight, score))]
            yield pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in SCORED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCORED)


def numbered(rows: DataFrame, order: list, path: str) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 ... in a total order, kept at ``path``; no task sees them all."""
    # The id counts rows within a partition in its low 33 bits and partitions above them.
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = kept(dealt.withColumn("place", F.monotonically_increasing_id()), path)
    part, position = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    # One row per partition of the shuffle.
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", before.alias("base"))
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(bases), "part")
        .withColumn("rank", F.col("base") + position + 1)
        .drop("part", "base", "place")
    )


def resampled(docs: DataFrame, target: DataFrame, folder: str, draw: Draw = Draw()) -> DataFrame:
    """Every row's doc_id, n_words, n_features, weight, score, and its rank if it is drawn."""
    gain = gains(docs, target, draw)
    rows = kept(scored(docs, gain, draw).withColumn("row_no", F.monotonically_increasing_id()), f"{folder}/scored")
    able = F.col("n_words") >= draw.min_words
    # One row per score value.
    levels = sorted(((r.score, r.n) for r in rows.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = draw.percent * sum(n for _, n in levels) // 100
    total, least = 0, None
    for score, n in levels:
        if total < wanted:
            total, least = total + n, score
    no_rank = F.lit(None).cast("long")
    if least is None:
        return rows.withColumn("rank", no_rank).drop("row_no")
    near = able & (F.col("score") >= least)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row_no").asc()]
    ranked = numbered(rows.where(near), order, f"{folder}/ranked")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return rows.where(~near).withColumn("rank", no_rank).unionByName(ranked).drop("row_no")
