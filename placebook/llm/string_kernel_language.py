"""Language of texts by a string kernel: which n-grams two texts share, whatever their counts.

The kernel of two texts is the number of n-grams of 1 to ``longest`` bytes that both hold, over the
geometric mean of how many each holds (a blended spectrum of presences). N-grams are hashed into
2**``bits`` places. A bounded sample of labelled texts gives landmarks; the kernel with the landmarks,
times the inverse root of the landmarks' own kernel matrix (Nyström), stands for the full kernel, and
one ridge regression per language against all others is solved in that space. Scoring multiplies a block
of presence rows with the landmarks' rows and the kernel values with the weights.

Letters are a-z after lower-casing and every non-ASCII character; all else is a single space. A language's
share of the sample is equal, so frequent languages are not preferred. ``sample`` bounds the labelled
texts that the model is fitted on, ``most_labels`` the languages (the most frequent ones); distinct
texts are chosen by the least hashes, so copies or a hot source do not fill the sample. Everything else
covers all rows.

A null text, and one without a letter, is "und" with score 0; so is every text if nothing can be learned.
A null doc_id is split like an empty one. Texts are taken whole: n-grams of a long one are marked in
pieces of a megabyte. Equal texts get equal results, in any table order. Only doc_id, text and lang
are read, lang for learning only. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebook.llm.words import Texts, runs, slices, texts

LETTER = np.zeros(256, bool)
LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SPACE = 0x20
UNKNOWN = "und"
#: Bytes of text whose n-grams are hashed at once, and texts whose presences are in memory at once.
PIECE, BLOCK = 1 << 20, 128


@dataclass(frozen=True)
class Kernel:
    """``sample``: most labelled texts to learn from; ``most_labels``: most languages."""

    longest: int = 4
    bits: int = 15
    landmarks: int = 128
    sample: int = 2048
    most_labels: int = 256
    ridge: float = 1e-4


@dataclass(frozen=True)
class Model:
    """``marks``: presences of the landmarks as packed bits; ``weights``: kernel value to language."""

    kernel: Kernel
    labels: tuple[str, ...]
    marks: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray


def spaced(column: pa.Array) -> Texts:
    """Words of letters in small letters, each with one space before it and one behind the last."""
    given = texts(pc.utf8_lower(column.cast(pa.large_string())))
    inside = LETTER[given.data]
    starts, ends, bounds = runs(inside, given.bounds)
    sizes, per = ends - starts, np.diff(bounds)
    edges = np.append(0, np.cumsum(sizes))[bounds] + bounds + np.append(0, np.cumsum(per > 0))
    out = np.full(edges[-1], SPACE, np.uint8)
    word = np.arange(len(sizes)) + 1 + np.repeat(np.append(0, np.cumsum(per > 0))[:-1], per)
    out[np.arange(sizes.sum()) + np.repeat(word, sizes)] = given.data[inside]
    return Texts(out, edges)


def presences(given: Texts, kernel: Kernel) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of texts: number of the first, and which hashed n-grams each text holds."""
    for first in range(0, len(given), BLOCK):
        bounds = given.bounds[first : first + BLOCK + 1]
        has = np.zeros((len(bounds) - 1) << kernel.bits, bool)
        for lo in range(int(bounds[0]), int(bounds[-1]), PIECE):
            hi = min(lo + PIECE, int(bounds[-1]))
            data = given.data[lo : min(hi + kernel.longest - 1, int(bounds[-1]))].astype(np.uint32)
            owner = np.searchsorted(bounds, np.arange(lo, hi), side="right") - 1
            left = bounds[owner + 1] - np.arange(lo, hi)  # bytes from here to the end of the text
            row = owner << kernel.bits
            h = np.zeros(hi - lo, np.uint32)
            for k in range(1, kernel.longest + 1):
                h = h[: len(data) - k + 1]
                h = (h + data[k - 1 : k - 1 + len(h)] + np.uint32(1)) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                place = (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - kernel.bits)
                fits = left[: len(h)] >= k
                has[(row[: len(h)] + place)[fits]] = True
        yield first, has.reshape(len(bounds) - 1, 1 << kernel.bits)


def unpacked(marks: np.ndarray) -> np.ndarray:
    return np.unpackbits(marks, axis=1).astype(np.float32)


def normal(sizes: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(sizes, 1)).astype(np.float32)


def kernel_matrix(has: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Kernel of presence rows with the presence rows of landmarks."""
    shared = has.astype(np.float32) @ marks.T
    return shared * normal(has.sum(1))[:, None] * normal(marks.sum(1))[None]


def solved(kernel: Kernel, labels: list[str], target: np.ndarray, bits: np.ndarray) -> Model:
    """Ridge regressions in the landmarks' space; ``bits``: presences of the sample, ``target``: its labels."""
    share = max(1, kernel.landmarks // max(1, len(labels)))
    chosen = np.concatenate([np.flatnonzero(target == k)[:share] for k in range(len(labels))])
    marks = unpacked(bits[chosen])
    rows = [kernel_matrix(unpacked(bits[lo : lo + BLOCK]), marks) for lo in range(0, len(bits), BLOCK)]
    values, vectors = np.linalg.eigh(kernel_matrix(marks, marks).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    space = np.concatenate(rows).astype(float) @ root
    wanted = (target[:, None] == np.arange(len(labels))).astype(float)
    middle, offset = space.mean(0), wanted.mean(0)
    centred = space - middle
    inner = centred.T @ centred + kernel.ridge * len(space) * np.eye(len(root))
    solution = np.linalg.solve(inner, centred.T @ (wanted - offset))
    return Model(kernel, tuple(labels), bits[chosen], root @ solution, offset - middle @ solution)


def sampled(docs: DataFrame, kernel: Kernel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, and label and presences of a bounded sample of distinct labelled texts."""
    key = F.xxhash64("text")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    per = rows.groupBy("lang").agg(F.approx_count_distinct(key, 0.02).alias("n"), F.count("*").alias("n_rows"))
    found = per.orderBy(F.col("n_rows").desc(), "lang").limit(kernel.most_labels).collect()
    labels = sorted(r.lang for r in found)
    if not labels:
        return [], np.zeros(0, np.int64), np.zeros((0, 1 << kernel.bits >> 3), np.uint8)
    share = max(1, kernel.sample // len(labels))
    # A text is taken if its hash is below its language's bound; twice the share on average.
    bounds = [(r.lang, labels.index(r.lang), min(1 << 31, int(2 * share / max(r.n, 1) * (1 << 31)) + 1)) for r in found]
    spread = F.pmod(F.xxhash64(key), F.lit(1 << 31))
    limits = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, label long, bound long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for first, has in presences(spaced(batch.column("text")), kernel):
                part = batch.slice(first, len(has))
                bits = pa.array([row.tobytes() for row in np.packbits(has, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("spread"), bits], ["label", "spread", "bits"])

    taken = rows.withColumn("spread", spread).join(limits, "lang").where("spread < bound").select("label", "spread", "text")
    bits = taken.mapInArrow(run, "label long, spread long, bits binary")
    # Copies of a text become one row; about 2 * sample rows remain, whatever the table.
    rows = sorted(tuple(r) for r in bits.groupBy("label", "spread").agg(F.min("bits").alias("bits")).collect())
    target = np.array([r[0] for r in rows], np.int64)
    keep = np.concatenate([np.flatnonzero(target == k)[:share] for k in range(len(labels))])
    packed = np.array([np.frombuffer(rows[i][2], np.uint8) for i in keep])
    return labels, target[keep], packed


def trained(docs: DataFrame, kernel: Kernel = Kernel()) -> Model | None:
    """A model from the texts and labels (lang) of ``docs``; None without any."""
    labels, target, bits = sampled(docs, kernel)
    return solved(kernel, labels, target, bits) if len(target) else None


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def _predict(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def told(batch: pa.RecordBatch, lang: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None:
            for batch in batches:
                yield told(batch, np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows))
            return
        marks, names = unpacked(model.marks), np.array(model.labels, object)
        for batch in slices(batches, "text"):
            column = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for first, has in presences(spaced(column), model.kernel):
                values = kernel_matrix(has, marks) @ model.weights + model.offsets
                best = values.argmax(axis=1)
                own = lettered[first : first + len(has)]
                score = np.clip(values[np.arange(len(has)), best], 0, 1)
                yield told(batch.slice(first, len(has)), np.where(own, names[best], UNKNOWN), np.where(own, score, 0.0))

    return run


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """Language and score of every row of ``docs`` (doc_id, text, held_out), in place: nothing is shuffled."""
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(model), PREDICTED)


def identified(docs: DataFrame, kernel: Kernel = Kernel()) -> DataFrame:
    """Learn from the rows that are not held out and tell the language of all rows."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).withColumn("held_out", held_out(F.col("doc_id")))
    return predicted(rows, trained(rows.where(~F.col("held_out")), kernel))
