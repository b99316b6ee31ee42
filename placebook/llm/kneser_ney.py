"""Interpolated modified Kneser-Ney bigram model, counted in Spark and read through memory maps.

Training texts are counted in tasks, and the counts of each part of the key space are summed in one
task each: first words, then pairs of words. Parts are ranges of a hash, so a frequent word or a
hot source is spread like any other, and map tasks sum before they send. The model is a folder of
files: sorted 64-bit word hashes with their counts, sorted pair hashes with their counts, and per
word the number of its occurrences as a context, its continuations by count, and the number of
words it follows. A word's rank in the sorted hashes is its id; a pair's hash is a bijection of its
two ids. Scoring tasks map the files and search them with sorted queries, so the model is never
loaded whole.

Words are cut at white space, A-Z made small; each text ends with an end token and starts after a
begin context. A null text is empty and has just its end token. A null doc_id is treated as an
empty one when rows are split for training. Texts are taken whole, in slices of a few megabytes cut
between texts; a longer text is a slice of its own. Counts of 2**32 or more are refused. Repeated rows count as often as they are there.
Only doc_id and text are read. Without training texts every token has probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebook.llm.shared import kept, mapped, write_file
from placebook.llm.words import LOWER, Texts, mix, slices, texts, words

#: Bytes of text for which the key space gets one part more.
PART_BYTES = 16 << 20
#: Tokens counted in a task before it sends its sums.
HOLD = 2_000_000
#: Not words: they hold white space.
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\r", b"\n"))
UNKNOWN = np.uint64((1 << 32) - 1)


@dataclass(frozen=True)
class Facts:
    """Small numbers of a model: all that is not in its files."""

    bits: int  # of the hash that name the part
    bases: tuple[int, ...]  # rank of the first word of each part
    tokens: int
    known: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_backoff: float


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts from the numbers of keys that occur once, twice, three and four times.

    On few or odd texts the estimate does not exist or leaves a count whole, and with it nothing for
    unseen words; half of each count is then taken off.
    """
    if min(n):
        y = n[0] / (n[0] + 2 * n[1])
        made = tuple(k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3))
        if all(0 < d < k + 1 for k, d in enumerate(made)):
            return made
    return 0.5, 1.0, 1.5


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: those of small numbers then compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(data: memoryview, count: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, count * size).reshape(size, count).T).view(kind).ravel()


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts as they are stored, in 32 bits; more than that is refused, not cut off."""
    if len(counts) and int(counts.max()) >= 1 << 32:
        raise OverflowError(f"a count of {int(counts.max())} does not fit 32 bits: use smaller training sets or wider files")
    return counts.astype(np.uint32)


def coded(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Ascending keys and 32-bit numbers for each."""
    return len(keys).to_bytes(8, "little") + _planes(np.diff(keys, prepend=np.uint64(0))) + b"".join(_planes(narrow(c)) for c in columns)


def decoded(data: bytes, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    count, view = int.from_bytes(data[:8], "little"), memoryview(data)[8:]
    keys = np.cumsum(_unplanes(view, count, np.uint64))
    rest = [_unplanes(view[8 * count + 4 * count * i :], count, np.uint32).astype(np.int64) for i in range(columns)]
    return keys, rest


def summed(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ascending distinct keys with the sums of their numbers."""
    if not len(keys):
        return keys, columns
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], [np.add.reduceat(c[order], first) for c in columns]


def part_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _parted(keys: np.ndarray, columns: list[np.ndarray], parts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One blob per part, from ascending keys."""
    order = np.argsort(parts, kind="stable")
    edges = np.flatnonzero(np.diff(parts[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = order[a:b]
        yield int(parts[own[0]]), coded(keys[own], [c[own] for c in columns])


def _lowered(column: pa.Array) -> Texts:
    given = texts(column)
    return Texts(LOWER[given.data], given.bounds)


def _counted(batches: Iterator[pa.RecordBatch], keys_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], parts_of: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Blobs (part, blob) of the counts of all keys of the texts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        keys, (counts,) = summed(np.concatenate([k for k, _ in held]), [np.concatenate([c for _, c in held])])
        part, blob = zip(*_parted(keys, [counts], parts_of(keys)), strict=True)
        return pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "blob": pa.array(blob, pa.binary())})

    for batch in slices(batches, "text"):
        held.append(keys_of(batch.column("text")))
        size += len(held[-1][0])
        if size > HOLD:
            yield out()
            held, size = [], 0
    if size:
        yield out()


COUNTED = "part int, blob binary"


def _count_words(bits: int):
    def keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = words(_lowered(column))
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found.known.to_pylist()), np.uint64, len(found.known))
        times = np.bincount(found.ids, minlength=len(own))
        # The begin context is no token: it gets an id, but no count.
        return np.concatenate([own, [END, BEGIN]]), np.concatenate([times, [len(column), 0]])

    return lambda batches: _counted(batches, keys, lambda h: part_of(h, bits))


def _decode_all(group: pa.Table, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    blobs = [decoded(b, columns) for b in group.column("blob").to_pylist()]
    return summed(np.concatenate([k for k, _ in blobs]), [np.concatenate(c) for c in zip(*(c for _, c in blobs), strict=True)])


def _write_words(folder: str) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        hashes, (counts,) = _decode_all(group, 1)
        write_file(folder, f"words-{part}", [hashes.tobytes()])
        write_file(folder, f"word-counts-{part}", [counts.astype(np.int64).tobytes()])
        return pa.table({"part": pa.array([part], pa.int32()), "size": [len(hashes)], "tokens": [int(counts.sum())], "known": [int((counts > 0).sum())]})

    return run


class Files:
    """The model's files, mapped on first use."""

    def __init__(self, folder: str, bits: int, bases: tuple[int, ...]) -> None:
        self.folder, self.bits, self.bases = folder, bits, bases
        self.open: dict[str, np.ndarray] = {}

    def array(self, name: str, part: int, kind: type) -> np.ndarray:
        key = f"{name}-{part}"
        if key not in self.open:
            self.open[key] = np.frombuffer(mapped(self.folder, key), kind)
        return self.open[key]

    def _by_part(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Part and bounds of sorted hashes."""
        edges = np.searchsorted(part_of(hashes, self.bits), np.arange((1 << self.bits) + 1))
        for part in np.flatnonzero(np.diff(edges)).tolist():
            yield part, int(edges[part]), int(edges[part + 1])

    def find(self, name: str, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For distinct hashes: part, numbers of the hashes that are there, and their places."""
        order = np.argsort(hashes)
        ordered = hashes[order]
        for part, a, b in self._by_part(ordered):
            there = self.array(name, part, np.uint64)
            if len(there):
                place = np.minimum(np.searchsorted(there, ordered[a:b]), len(there) - 1)
                hit = there[place] == ordered[a:b]
                yield part, order[a:b][hit], place[hit]

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), UNKNOWN, np.uint64)
        for part, which, place in self.find("words", hashes):
            out[which] = place + self.bases[part]
        return out

    def dense(self, name: str, ranks: np.ndarray, kind: type) -> np.ndarray:
        """Entries by rank; 0 for unknown words."""
        out = np.zeros(len(ranks), np.int64)
        part = np.searchsorted(np.array(self.bases), ranks.astype(np.int64), side="right") - 1
        for p in np.unique(part[ranks != UNKNOWN]).tolist():
            own = np.flatnonzero((part == p) & (ranks != UNKNOWN))
            out[own] = self.array(name, p, kind)[ranks[own].astype(np.int64) - self.bases[p]]
        return out


@lru_cache(maxsize=2)
def files(folder: str, bits: int, bases: tuple[int, ...]) -> Files:
    """The files of a model, mapped once in a worker process."""
    return Files(folder, bits, bases)


def tokens_of(column: pa.Array, model: Files) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of all tokens and of the tokens before them, and each text's bounds."""
    found = words(_lowered(column))
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found.known.to_pylist()), np.uint64, len(found.known))
    rank = model.ranks(np.concatenate([own, [END, BEGIN]]))
    count = len(column)
    bounds = found.bounds + np.arange(count + 1)
    token = np.full(len(found.ids) + count, rank[-2], np.uint64)
    token[np.arange(len(found.ids)) + found.text_of()] = rank[:-2][found.ids]
    before = np.empty(len(token), np.uint64)
    before[1:] = token[:-1]
    before[bounds[:-1]] = rank[-1]
    return token, before, bounds


def _count_pairs(folder: str, bits: int, bases: tuple[int, ...]):
    def keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        token, before, _ = tokens_of(column, files(folder, bits, bases))
        return before << np.uint64(32) | token, np.ones(len(token), np.int64)

    return lambda batches: _counted(batches, keys, lambda k: part_of(mix(k), bits))


PAIR_SUMS = "pair_part int, part int, blob binary, n1 long, n2 long, n3 long, n4 long, pairs long"


def _write_pairs(folder: str, bases: tuple[int, ...]) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        keys, (counts,) = _decode_all(group, 1)
        hashes = mix(keys)
        order = np.argsort(hashes)
        write_file(folder, f"pairs-{part}", [hashes[order].tobytes()])
        write_file(folder, f"pair-counts-{part}", [narrow(counts[order]).tobytes()])
        # What each word is as a context, and as a continuation.
        none = np.zeros(len(keys), np.int64)
        as_context = [counts, counts == 1, counts == 2, counts > 2, none]
        as_word = [none, none, none, none, none + 1]
        ranks, sums = summed(
            np.concatenate([keys >> np.uint64(32), keys & UNKNOWN]),
            [np.concatenate([x.astype(np.int64), y]) for x, y in zip(as_context, as_word, strict=True)],
        )
        place = np.searchsorted(np.array(bases), ranks.astype(np.int64), side="right") - 1
        parts, blobs = zip(*_parted(ranks, sums, place), strict=True)
        once = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        rest = {f"n{k}": [once[k - 1]] + [0] * (len(parts) - 1) for k in (1, 2, 3, 4)}
        return pa.table(
            {"pair_part": pa.array([part] * len(parts), pa.int32()), "part": pa.array(parts, pa.int32()), "blob": pa.array(blobs, pa.binary())}
            | rest
            | {"pairs": [len(keys)] + [0] * (len(parts) - 1)}
        )

    return run


STATS = ("total", "once", "twice", "more", "follows")


def _write_stats(folder: str, sizes: tuple[int, ...], bases: tuple[int, ...]) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        ranks, sums = _decode_all(group, len(STATS))
        place = ranks.astype(np.int64) - bases[part]
        for name, values in zip(STATS, sums, strict=True):
            dense = np.zeros(sizes[part], np.int64)
            dense[place] = values
            write_file(folder, f"{name}-{part}", [dense.tobytes()])
        follows = sums[-1]
        told = {f"n{k}": [int((follows == k).sum())] for k in (1, 2, 3, 4)}
        return pa.table({"part": pa.array([part], pa.int32())} | told | {"more": [int((follows > 2).sum())]})

    return run


def train(texts_: DataFrame, folder: str, part_bytes: int = PART_BYTES) -> Facts:
    """Count a model of the column ``text`` into files below ``folder``."""
    texts_ = texts_.select("text")
    size = texts_.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (size // part_bytes).bit_length())
    all_parts = 1 << bits

    def by_part(df: DataFrame) -> DataFrame:
        return df.repartition(all_parts, "part").groupBy("part")

    vocabulary = kept(
        by_part(texts_.mapInArrow(_count_words(bits), COUNTED)).applyInArrow(_write_words(folder), "part int, size long, tokens long, known long"),
        f"{folder}/told-words",
    ).collect()  # one row per part
    sizes = {r.part: r.size for r in vocabulary}
    listed = tuple(sizes.get(p, 0) for p in range(all_parts))
    bases = tuple(int(x) for x in np.concatenate([[0], np.cumsum(listed)[:-1]]))
    if sum(listed) >= int(UNKNOWN):
        raise ValueError("more than 2^32 distinct words")
    # Parts without words share their base with the next one; files for them are empty.
    for part, count in enumerate(listed):
        if not count:
            for name in ("words", "word-counts", *STATS):
                write_file(folder, f"{name}-{part}", [])
    pairs = kept(
        by_part(texts_.mapInArrow(_count_pairs(folder, bits, bases), COUNTED)).applyInArrow(_write_pairs(folder, bases), PAIR_SUMS),
        f"{folder}/told-pairs",
    )
    written = {r.pair_part for r in pairs.select("pair_part").distinct().collect()}  # one row per part
    for part in set(range(all_parts)) - written:
        write_file(folder, f"pairs-{part}", [])
        write_file(folder, f"pair-counts-{part}", [])
    n = pairs.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in (1, 2, 3, 4)], F.coalesce(F.sum("pairs"), F.lit(0))).first()
    stats = kept(
        by_part(pairs.select("part", "blob")).applyInArrow(_write_stats(folder, listed, bases), "part int, n1 long, n2 long, n3 long, n4 long, more long"),
        f"{folder}/told-stats",
    ).collect()  # one row per part
    w = [sum(r[f"n{k}"] for r in stats) for k in (1, 2, 3, 4)]
    d = discounts(w)
    total = n[4]
    backoff = (d[0] * w[0] + d[1] * w[1] + d[2] * sum(r.more for r in stats)) / total if total else 1.0
    return Facts(
        bits, bases, sum(r.tokens for r in vocabulary), sum(r.known for r in vocabulary), total, discounts(list(n[:4])), d, backoff
    )


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(folder: str, facts: Facts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = files(folder, facts.bits, facts.bases)
        d2, d1 = (np.array([0.0, *d]) for d in (facts.pair_discounts, facts.word_discounts))
        for batch in slices(batches, "text"):
            token, before, bounds = tokens_of(batch.column("text"), model)
            # Each distinct word and pair is looked up once.
            word, word_at = np.unique(token, return_inverse=True)
            count = model.dense("word-counts", word, np.int64)
            follows = model.dense("follows", word, np.int64)
            p1 = facts.word_backoff / (facts.known + 1)
            if facts.pairs:
                p1 = p1 + np.maximum(follows - d1[np.minimum(follows, 3)], 0) / facts.pairs
            p1 = np.broadcast_to(p1, len(word))
            pair, first, pair_at = np.unique(before << np.uint64(32) | token, return_index=True, return_inverse=True)
            seen = np.zeros(len(pair), np.int64)
            for part, which, place in model.find("pairs", mix(pair)):
                seen[which] = model.array("pair-counts", part, np.uint32)[place]
            context, context_at = np.unique(pair >> np.uint64(32), return_inverse=True)
            total, once, twice, more = (model.dense(name, context, np.int64).astype(float) for name in STATS[:4])
            known = np.maximum(total, 1)
            weight = np.where(total > 0, (d2[1] * once + d2[2] * twice + d2[3] * more) / known, 1.0)
            p = np.maximum(seen - d2[np.minimum(seen, 3)], 0) / known[context_at] + weight[context_at] * p1[word_at[first]]
            base = np.log10((count + 0.5) / (facts.tokens + 0.5 * (facts.known + 1)))
            at = bounds[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(np.diff(bounds)),
                    pa.array(np.add.reduceat((count > 0)[word_at].astype(np.int64), at)),
                    pa.array(np.full(len(at), facts.tokens)),
                    pa.array(np.add.reduceat(base[word_at], at)),
                    pa.array(np.add.reduceat(np.log10(p)[pair_at], at)),
                ],
                [field.split()[0] for field in SCORED.split(", ")],
            )

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def scored(docs: DataFrame, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Train on the rows that are not held out and score all rows of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    facts = train(rows.where(~F.col("held_out")), folder, part_bytes)
    write_file(folder, "facts.json", [json.dumps(asdict(facts)).encode()])
    return rows.mapInArrow(_score(folder, facts), SCORED)
