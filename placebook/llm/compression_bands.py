"""Quality rules by compression: texts that compress too well or hardly at all are rejected.

A text's ratio is its bytes divided by their zstandard size. Repeated text has a high ratio, noise
a low one. What is usual depends on the length, so limits are given by length; a text is judged
as a whole and in fixed chunks, which finds junk inside a long text that the whole hides.

What a table's clean texts look like is learned from its own labels: ``fitted`` takes all texts
that are labelled clean and pass the base rules, and sets per length the mean ratio less 10
standard deviations as the least and the mean plus 5, or the most of a clean text, as the most. Junk that
lies close to clean text is told by that. Lengths with few labelled texts, and tables without labels,
keep the wide limits of ``Bands``, which ordinary prose, source code and printed tables pass; they
reject noise and long runs of the same.

Every text is judged whole. Null and empty texts have no words and fail the base rules. Rows are
judged one by one: equal rows get equal results, any further columns stay out of the way, and an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import ceil, floor

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.llm.words import SPACE, Texts, Words, named, per_text, slices, texts, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


#: Lengths in bytes from which limits of their own hold.
LENGTHS = (0, 256, 512, 768, 1024, 1536, 2048, 3072, 4096, 5120, 6144, 8192, 12288, 16384, 65536)


def _wide(length: int) -> tuple[int, float, float]:
    """Limits that ordinary texts of a length keep to; a short text hardly compresses."""
    least = 0.0 if length < 256 else 1.1 if length < 1024 else 1.25 if length < 4096 else 1.4
    most = 4.0 if length < 1024 else 5.0 if length < 4096 else 7.0 if length < 16384 else 10.0
    return length, least, most


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by length in bytes; the last row whose length is reached applies.

    ``limits``: (bytes, least ratio, most ratio) of whole texts. ``chunk_limits``: the same of the
    chunks of a text that has several. ``chunk_bytes``: length of a chunk; a rest of less than half
    a chunk belongs to the chunk before it. ``bad_share``: a text is rejected if more than this share
    of its chunks is outside the limits of their length.
    """

    limits: tuple[tuple[int, float, float], ...] = tuple(_wide(n) for n in LENGTHS)
    chunk_limits: tuple[tuple[int, float, float], ...] = tuple((n, 1.25, 10.0) for n in (0, 2560, 3072, 3584, 4096, 5120))
    chunk_bytes: int = 4096
    bad_share: float = 0.5
    level: int = 3

    def outside(self, size: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        return _outside(self.limits, size, ratio)

    def chunk_outside(self, size: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        return _outside(self.chunk_limits, size, ratio)


def _outside(limits: tuple[tuple[int, float, float], ...], size: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    lengths, least, most = (np.array(x) for x in zip(*limits, strict=True))
    row = np.searchsorted(lengths, size, side="right") - 1
    return (ratio < least[row]) | (ratio > most[row])


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


def duplicate_lines(given: Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    data, bounds = given.data, given.bounds
    breaks = data == 10
    edges = np.unique(np.concatenate([bounds, np.flatnonzero(breaks) + 1]))
    if len(edges) < 2:
        return np.zeros(len(given), np.int64)
    first, last = edges[:-1], edges[1:]
    sizes = last - first - breaks[last - 1]
    with_word = per_text(~SPACE[data], np.append(first, last[-1])) > 0
    line, _ = named(data[~breaks], sizes)
    owner = np.searchsorted(bounds, first, side="right") - 1
    key = owner[with_word] * (int(line.max()) + 1) + line[with_word]
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    return np.bincount(owner[with_word][again], minlength=len(given))


def repeated_words(found: Words, n: int = 3) -> np.ndarray:
    """Words of each text that lie in a window of n words occurring twice or more in the text."""
    owner, count = found.text_of(), len(found.ids)
    covered = np.zeros(count, bool)
    if count >= n:
        gram = found.ids[: count - n + 1].astype(np.int64)
        for k in range(1, n):  # numbers of longer and longer grams; equal numbers mean equal words
            gram = np.unique(gram * len(found.known) + found.ids[k : count - n + 1 + k], return_inverse=True)[1]
        at = np.flatnonzero(owner[: len(gram)] == owner[n - 1 :])
        at = at[np.bincount(gram)[gram[at]] > 1]
        _, which, times = np.unique(owner[at] * (int(gram.max()) + 1) + gram[at], return_inverse=True, return_counts=True)
        at = at[times[which] > 1]
        for k in range(n):
            covered[at + k] = True
    return per_text(covered, found.bounds)


def _ratios(given: Texts, bands: Bands) -> Iterator[tuple[int, int, float, np.ndarray, np.ndarray]]:
    """Of each text with bytes: its number, size and ratio, and sizes and ratios of its chunks if several."""
    pack = zstandard.ZstdCompressor(level=bands.level).compress
    view = memoryview(given.data)
    for i, (a, b) in enumerate(zip(given.bounds[:-1].tolist(), given.bounds[1:].tolist(), strict=True)):
        if a == b:
            continue
        ratio = (b - a) / len(pack(view[a:b]))
        n = max(1, int((b - a) / bands.chunk_bytes + 0.5))
        if n == 1:
            yield i, b - a, ratio, np.zeros(0, np.int64), np.zeros(0)
            continue
        edges = np.append(np.arange(n) * bands.chunk_bytes, b - a) + a
        size = np.diff(edges)
        packed = [len(pack(view[x:y])) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        yield i, b - a, ratio, size, size / np.array(packed)


def _judged_ratios(given: Texts, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratio of each whole text, its number of chunks, and how many are outside the limits."""
    ratio, chunks, bad = (np.zeros(len(given), t) for t in (float, np.int64, np.int64))
    for i, size, whole, sizes, parts in _ratios(given, bands):
        ratio[i] = whole
        chunks[i] = max(1, len(sizes))
        bad[i] = bands.chunk_outside(sizes, parts).sum() if len(sizes) else bands.outside(size, whole)
    return ratio, chunks, bad


def _base(given: Texts, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and repeated words of each text, and whether it fails the base rules."""
    n_words = np.diff(found.bounds)
    repeated = repeated_words(found)
    return n_words, repeated, (n_words < 50) | (100 * repeated > 50 * n_words)


def _verdicts(batch: pa.RecordBatch, bands: Bands) -> dict[str, np.ndarray]:
    given = texts(batch.column("text"))
    starts_a_point = (given.data & 0xC0) != 0x80
    n_words, repeated, failed = _base(given, words(given))
    ratio, chunks, bad = _judged_ratios(given, bands)
    rejected = bands.outside(np.diff(given.bounds), ratio) | (bad > bands.bad_share * chunks)
    return {
        "n_words": n_words,
        "word_chars": per_text(starts_a_point & ~SPACE[given.data], given.bounds),
        "n_symbols": per_text(SYMBOLS[given.data], given.bounds),
        "n_dup_lines": duplicate_lines(given),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "kept": ~failed & ~rejected,
        "ratio": ratio,
        "n_chunks": chunks,
        "n_bad_chunks": bad,
    }


def _judge(bands: Bands) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            verdicts = _verdicts(batch, bands)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *verdicts.values()], ["doc_id", *verdicts])

    return run


def judged(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """A verdict for each row of ``docs`` (doc_id, text), in place: nothing is shuffled."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_judge(bands), SCHEMA)


def accepted(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    names, numbers = docs.columns, [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices((b.rename_columns(names) for b in batches), "text"):
            yield batch.filter(pa.array(_verdicts(batch, bands)["kept"])).rename_columns(numbers)

    # Under numbers on the way: a name with a dot cannot be handed over.
    numbered = docs.toDF(*numbers)
    return numbered.mapInArrow(run, numbered.schema).toDF(*names)


def fitted(docs: DataFrame, labels: DataFrame, sample: int | None = None, bands: Bands = Bands()) -> Bands:
    """``bands`` with limits from all texts of ``docs`` that pass the base rules and whose ``labels`` (doc_id,
    quality) say 1; only with ``sample`` from those of at most so many ids, with the least hashes. A length
    with fewer than 10 texts or chunks keeps its limits, and so do the first and the last length of whole
    texts. Ratios are taken where a text lies and joined with the labels as numbers: no text is shuffled.
    """
    rows = {"text": bands.limits, "chunk": bands.chunk_limits}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            given = texts(batch.column("text"))
            failed = _base(given, words(given))[2]
            out = []
            for i, size, whole, sizes, parts in _ratios(given, bands):
                if not failed[i]:
                    out += [(i, "text", size, whole)] + [(i, "chunk", *x) for x in zip(sizes.tolist(), parts.tolist(), strict=True)]
            at = {kind: np.array([x[0] for x in limits]) for kind, limits in rows.items()}
            row = [int(np.searchsorted(at[kind], size, side="right")) - 1 for _, kind, size, _ in out]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array([x[0] for x in out], pa.int64())),
                    pa.array([x[1] for x in out], pa.string()),
                    pa.array(row, pa.int64()),
                    pa.array([x[3] for x in out], pa.float64()),
                ],
                ["doc_id", "kind", "row", "ratio"],
            )

    chosen = labels.where("quality = 1").select("doc_id").distinct()
    if sample is not None:
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    own = narrow.schema["doc_id"].dataType.simpleString()
    ratios = narrow.where("doc_id IS NOT NULL").mapInArrow(run, f"doc_id {own}, kind string, row long, ratio double").join(chosen, "doc_id")
    found = {(r.kind, r.row): r for r in ratios.groupBy("kind", "row").agg(
        F.avg("ratio").alias("mean"), F.stddev_samp("ratio").alias("sd"), F.max("ratio").alias("most"), F.count("*").alias("n")).collect()}

    def limits(kind: str, fixed: set[int]) -> tuple[tuple[int, float, float], ...]:
        out = []
        for i, given in enumerate(rows[kind]):
            r = found.get((kind, i))
            known = r is not None and r.n >= 10 and i not in fixed
            out.append((given[0], max(floor(100 * (r.mean - 10 * r.sd)), 0) / 100, ceil(100 * max(r.mean + 5 * r.sd, r.most)) / 100) if known else given)
        return tuple(out)

    return replace(bands, limits=limits("text", {0, len(bands.limits) - 1}), chunk_limits=limits("chunk", set()))
