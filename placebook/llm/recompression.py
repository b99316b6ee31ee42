"""Removal of long passages that an earlier document has, found by recompression.

Rounds of recompression rename a text: runs of one symbol become one symbol, then symbols are split
into left and right ones by a bit of their name, and each left one followed by a right one becomes
a pair. A name is a hash of what it stands for, so equal content gets equal names in every document
without any exchange. Each symbol knows its context, the words that decided it: wherever these
words stand, the symbol stands as well. A passage of ``window`` words therefore has the same symbols
inside, whatever stands around it.

Every window takes as its anchor the symbol of the highest round whose context lies within it, of
several the one of least hash, then the first. Equal windows have equal anchors; a word itself is the
anchor of last resort, so none is missed. Consecutive windows of one anchor are a block. Spark joins
blocks by the content of their anchors' contexts: blocks that equal a block of an earlier document are
removed whole, and of anchors that stand in different blocks the windows themselves are compared,
by 128 bits of hash. So hot passages cost one row per block, and few windows become rows.

Windows lie within one document. A null or empty text has no words. A null doc_id counts as larger than
any other. Rows of equal doc_id remove nothing from each other. Texts are taken whole, in slices of a
few megabytes cut between texts; a longer text is a slice of its own. Only doc_id and text are read;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.llm.shared import kept
from placebook.llm.words import mix, slices, texts, words

WINDOW, ROUNDS = 50, 4
LAST = (1 << 63) - 1
FAR = 1 << 40  # a context that reaches beyond the document
ODD = np.uint64(0x9E3779B97F4A7C15)


class Symbols:
    """Symbols in text order: name, document, and the words [left, right) that decided each."""

    def __init__(self, name: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        self.name, self.doc, self.left, self.right = name, doc, left, right

    @staticmethod
    def of_words(hashes: np.ndarray, doc: np.ndarray) -> Symbols:
        at = np.arange(len(hashes), dtype=np.int64)
        return Symbols(hashes, doc, at, at + 1)

    def _with_neighbour(self, left: np.ndarray, right: np.ndarray, first: np.ndarray, last: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        """Widen contexts by the symbols before ``first`` and after ``last`` where marked."""
        n = len(self.doc)
        for wanted, own, other in ((before, first, first - 1), (after, last, last + 1)):
            inside = (other >= 0) & (other < n)
            other = np.clip(other, 0, n - 1)
            inside &= self.doc[other] == self.doc[own]
            near, beyond = wanted & inside, wanted & ~inside
            left[near] = np.minimum(left[near], self.left[other[near]])
            right[near] = np.maximum(right[near], self.right[other[near]])
            left[beyond], right[beyond] = -FAR, FAR

    def runs(self) -> Symbols:
        """Every maximal run of a symbol as one symbol."""
        new = np.ones(len(self.name), bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        length = (last - first + 1).astype(np.uint64)
        name = np.where(length > 1, mix(self.name[first] * ODD + length), self.name[first])
        left, right = np.minimum.reduceat(self.left, first), np.maximum.reduceat(self.right, first)
        always = np.ones(len(first), bool)
        self._with_neighbour(left, right, first, last, always, always)
        return Symbols(name, self.doc[first], left, right)

    def pairs(self, turn: int) -> Symbols:
        """Every left symbol followed by a right one as one symbol."""
        is_left = (mix(self.name + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(self.name), bool)
        joins[:-1] = is_left[:-1] & ~is_left[1:] & (self.doc[1:] == self.doc[:-1])
        head = np.ones(len(joins), bool)
        head[1:] = ~joins[:-1]
        first = np.flatnonzero(head)
        paired = joins[first]
        last = first + paired
        name = np.where(paired, mix(mix(self.name[first] + ODD) + self.name[last]), self.name[first])
        left, right = np.minimum(self.left[first], self.left[last]), np.maximum(self.right[first], self.right[last])
        self._with_neighbour(left, right, first, last, ~paired & ~is_left[first], ~paired & is_left[first])
        return Symbols(name, self.doc[first], left, right)


class Sums:
    """Hashes of stretches of words that do not depend on where they stand."""

    def __init__(self, hashes: np.ndarray, base: int) -> None:
        step, back = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        count = len(hashes)

        def powers(x: np.uint64) -> np.ndarray:
            out = np.full(count + 1, x, np.uint64)
            out[0] = 1
            return np.cumprod(out)

        self.total = np.zeros(count + 1, np.uint64)
        np.cumsum(mix(hashes + np.uint64(base)) * powers(step)[:count], out=self.total[1:])
        self.back = powers(back)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.total[last] - self.total[first]) * self.back[first] + (last - first).astype(np.uint64))


def anchors(hashes: np.ndarray, bounds: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts, and for each the content hash of its anchor's context."""
    count = len(hashes)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    open_ = np.zeros(count, bool)  # windows that have no anchor yet
    at = np.arange(count)
    open_[at + window <= bounds[1:][doc]] = True
    starts = np.flatnonzero(open_)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    levels = [Symbols.of_words(hashes, doc)]
    for turn in range(rounds):
        levels.append(levels[-1].runs().pairs(turn))
    sums = Sums(hashes, 0xD6E8FEB86659FD93)
    chosen = np.zeros(count, np.uint64)
    for level in range(rounds, -1, -1):
        s = levels[level]
        first = np.maximum(s.right - window, bounds[:-1][s.doc])
        last = np.minimum(s.left, bounds[1:][s.doc] - window)
        waiting = np.concatenate([[0], np.cumsum(open_)])
        fits = np.flatnonzero(first <= last)
        fits = fits[waiting[last[fits] + 1] > waiting[first[fits]]]
        if not len(fits):
            continue
        first, last = first[fits], last[fits]
        key = (mix(s.name[fits] ^ ODD) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(fits), dtype=np.uint64)
        least = _least(first, last, key, count, window)
        done = open_ & (least != np.uint64(LAST * 2 + 1))
        pick = fits[(least[done] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        chosen[done] = mix(sums.of(s.left[pick], s.right[pick]) + np.uint64(level))
        open_ &= ~done
    return starts, chosen[starts]


def _least(first: np.ndarray, last: np.ndarray, key: np.ndarray, count: int, window: int) -> np.ndarray:
    """For each place the least key of the intervals [first, last] over it; all ones if there is none."""
    depth = window.bit_length()
    none = np.uint64(LAST * 2 + 1)
    table = np.full((depth, count), none, np.uint64)
    power = np.zeros(window + 2, np.int64)
    power[1:] = np.floor(np.log2(np.arange(1, window + 2))).astype(np.int64)
    k = power[last - first + 1]
    for d in range(depth):  # an interval is two overlapping stretches of 2^d
        own = k == d
        np.minimum.at(table[d], first[own], key[own])
        np.minimum.at(table[d], last[own] - (1 << d) + 1, key[own])
    for d in range(depth - 1, 0, -1):
        half = 1 << (d - 1)
        np.minimum(table[d - 1], table[d], out=table[d - 1])
        table[d - 1][half:] = np.minimum(table[d - 1][half:], table[d][:-half])
    return table[0]


BLOCKS = "anchor long, content long, rank long, text_key long, first int, count int"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _find_blocks(window: int, rounds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = words(texts(batch.column("text")))
            hashes, bounds = found.hashes(), found.bounds
            starts, anchor = anchors(hashes, bounds, window, rounds)
            if not len(starts):
                continue
            doc = found.text_of()[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(starts)))
            where = starts[first]
            content = Sums(hashes, 0xA0761D6478BD642F).of(where, where + sizes + window - 1)
            owner = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_signed(anchor[first])),
                    pa.array(_signed(content)),
                    batch.column("rank").take(owner),
                    batch.column("text_key").take(owner),
                    pa.array((where - bounds[doc[first]]).astype(np.int32)),
                    pa.array(sizes.astype(np.int32)),
                ],
                ["anchor", "content", "rank", "text_key", "first", "count"],
            )

    return run


def _spans(column: pa.Array, names: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, and two numbers, of every entry of a list column."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), *(flat.field(n).to_numpy().astype(np.int64) for n in names)


WINDOWS = "one long, two long, rank long, text_key long, first int"


def _find_windows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = words(texts(batch.column("text")))
            hashes = found.hashes()
            row, first, count = _spans(batch.column("blocks"), ("first", "count"))
            owner = np.repeat(row, count)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            at = found.bounds[owner] + place
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(_signed(Sums(hashes, base).of(at, at + window))) for base in (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)),
                    batch.column("rank").take(pa.array(owner)),
                    batch.column("text_key").take(pa.array(owner)),
                    pa.array(place.astype(np.int32)),
                ],
                ["one", "two", "rank", "text_key", "first"],
            )

    return run


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _keep(with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            given = texts(batch.column("text"))
            found = words(given)
            row, first, last = _spans(batch.column("removed"), ("first", "last"))
            change = np.zeros(len(found.ids) + 1, np.int64)
            np.add.at(change, found.bounds[row] + first, 1)
            np.add.at(change, found.bounds[row] + last, -1)
            stays = np.cumsum(change[:-1]) == 0
            data = given.data.tobytes()
            hashes, out, removed = [], [], []
            for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
                own = np.flatnonzero(stays[a:b]) + a
                pieces = zip(found.starts[own].tolist(), found.ends[own].tolist(), strict=True)
                text = b" ".join([data[x:y] for x, y in pieces])
                hashes.append(hashlib.sha256(text).hexdigest())
                out.append(text.decode("utf-8", "replace") if with_text else None)
                removed.append(b - a - len(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(found.bounds)), pa.array(removed, pa.int64()), pa.array(hashes), pa.array(out, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def without_repeats(docs: DataFrame, folder: str, window: int = WINDOW, rounds: int = ROUNDS, with_text: bool = True) -> DataFrame:
    """Every row of ``docs`` without the words that windows of earlier documents cover."""
    text = F.col("text").cast("string")
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rank.alias("rank"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    blocks = kept(rows.select("rank", "text_key", "text").mapInArrow(_find_blocks(window, rounds), BLOCKS), f"{folder}/blocks")

    # Anchors that stand in more than one document, and the first document of each block.
    contents = blocks.groupBy("anchor", "content").agg(F.min("rank").alias("owner"), F.max("rank").alias("latest"))
    contents = kept(contents, f"{folder}/contents")
    shared = (
        contents.groupBy("anchor")
        .agg(F.count("*").alias("kinds"), F.min("owner").alias("earliest"), F.max("latest").alias("latest"))
        .where("earliest < latest")
        .select("anchor", (F.col("kinds") > 1).alias("contested"))
    )
    told = contents.select("anchor", "content", "owner").join(shared, "anchor")
    hits = kept(
        blocks.join(told, ["anchor", "content"])
        .where("rank > owner or contested")
        .select("rank", "text_key", "first", "count", (F.col("rank") > F.col("owner")).alias("repeats")),
        f"{folder}/hits",
    )
    whole = hits.where("repeats").select("rank", "text_key", "first", (F.col("first") + F.col("count") + (window - 1)).alias("last"))

    # Windows of first blocks whose anchors stand in other blocks as well.
    contested = hits.where("not repeats").groupBy("rank", "text_key").agg(F.collect_set(F.struct("first", "count")).alias("blocks"))
    windows = kept(
        rows.select("rank", "text_key", "text").join(contested, ["rank", "text_key"]).mapInArrow(_find_windows(window), WINDOWS),
        f"{folder}/windows",
    )
    owners = windows.groupBy("one", "two").agg(F.min("rank").alias("owner"), F.max("rank").alias("latest")).where("owner < latest")
    single = (
        windows.join(owners, ["one", "two"])
        .where("rank > owner")
        .select("rank", "text_key", "first", (F.col("first") + window).alias("last"))
    )
    removed = whole.unionAll(single).groupBy("rank", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("removed"))
    return (
        rows.join(removed, ["rank", "text_key"], "left")
        .select("doc_id", "text", "removed")
        .mapInArrow(_keep(with_text), KEPT)
    )
