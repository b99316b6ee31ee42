"""Packing of documents into sequences of several lengths.

A document's ids, cut into whole longest windows and a rest, are routed by the length of the rest to
the shortest window tier that holds it. Tiers are packed from long to short: each window starts
with a rest of its tier, its gap takes the longest whole rests of shorter tiers that fit, and what
is then left of the gap is cut from one more. Windows whose gap nothing can fill are taken apart
and laid end to end into full windows. So every sequence is exactly as long as a tier, but for one
short one per group. Sequences of a tier are then dealt into step groups of equal tokens and
near equal attention cost (the sum of the squares of their pieces).

Documents are dealt by hash into groups of a few megabytes of text, whatever their source or
length, and each group is encoded and packed in one go; a single longer document is a group's
largest content. Null texts are empty and have just their end id. Repeated rows are packed each.
Further columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.llm.chunked_ids import encoder, with_end
from placebook.llm.words import slices, texts

#: Bytes of text in a group, about.
GROUP_BYTES = 8 << 20

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "window int, step long"
)


@dataclass(frozen=True)
class Packing:
    tiers: tuple[int, ...] = (512, 1024, 2048, 4096)
    step_tokens: int = 65536


@dataclass
class Sequence:
    window: int
    pieces: list[tuple[int, int, int]]  # (document, start, length)

    def cost(self) -> int:
        return sum(n * n for _, _, n in self.pieces)


class _Rests:
    """Rests of documents in order of length."""

    def __init__(self) -> None:
        self.held: list[tuple[int, int, int]] = []  # (length, document, start)

    def put(self, length: int, doc: int, start: int) -> None:
        insort(self.held, (length, doc, start))

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest of at most ``most`` ids."""
        at = bisect_right(self.held, (most, float("inf"), 0))
        return self.held.pop(at - 1) if at else None


def packed(lengths: list[int], tiers: tuple[int, ...]) -> list[Sequence]:
    """Sequences holding each id of the documents once."""
    longest = tiers[-1]
    out: list[Sequence] = []
    rests = _Rests()
    for doc, n in enumerate(lengths):
        for at in range(0, n - longest + 1, longest):
            out.append(Sequence(longest, [(doc, at, longest)]))
        if rest := n % longest:
            rests.put(rest, doc, n - rest)
    loose: list[tuple[int, int, int]] = []
    for tier, shorter in zip(tiers[::-1], (*tiers[-2::-1], 0), strict=True):
        # The last tier holds all that is left; its windows are filled from itself.
        while rests.held and rests.held[-1][0] > shorter:
            n, doc, start = rests.held.pop()
            pieces, gap = [(doc, start, n)], tier - n
            while gap:
                if fits := rests.take(min(gap, shorter) if shorter else gap):
                    pieces.append((fits[1], fits[2], fits[0]))
                    gap -= fits[0]
                elif donor := rests.take(shorter or tier):
                    pieces.append((donor[1], donor[2], gap))
                    rests.put(donor[0] - gap, donor[1], donor[2] + gap)
                    gap = 0
                else:
                    break
            if gap:
                loose += pieces
            else:
                out.append(Sequence(tier, pieces))
    left = sum(n for _, _, n in loose)
    loose.reverse()
    while left:
        window = next((t for t in tiers[::-1] if t <= left), longest)
        room, pieces = min(window, left), []
        left -= room
        while room:
            doc, start, n = loose.pop()
            if n > room:
                loose.append((doc, start + room, n - room))
                n = room
            pieces.append((doc, start, n))
            room -= n
        out.append(Sequence(window, pieces))
    return out


def steps_of(sequences: list[Sequence], step_tokens: int) -> list[int]:
    """A step for each sequence: one window length per step, equal numbers, costs dealt to and fro."""
    steps = [0] * len(sequences)
    used = 0
    for window in sorted({s.window for s in sequences}):
        own = sorted((i for i, s in enumerate(sequences) if s.window == window), key=lambda i: (-sequences[i].cost(), i))
        count = -(-len(own) // max(1, step_tokens // window))
        for rank, i in enumerate(own):
            turn, place = divmod(rank, count)
            steps[i] = used + (place if turn % 2 == 0 else count - 1 - place)
        used += count
    return steps


def _pack_group(path: str, end: int, packing: Packing) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        encode = encoder(path).ids
        ids, bounds = [], [np.zeros(1, np.int64)]
        for batch in slices(iter(group.combine_chunks().to_batches()), "text", GROUP_BYTES):
            some, ends = with_end(*encode(texts(batch.column("text"))), end)
            bounds.append(ends[1:] + bounds[-1][-1])
            ids.append(some)
        flat = np.concatenate(ids).astype("<u4")
        bounds = np.concatenate(bounds)
        sequences = packed(np.diff(bounds).tolist(), packing.tiers)
        steps = steps_of(sequences, packing.step_tokens)
        place = int(group.column("packing_group")[0].as_py()) << 24
        rows = [
            (doc, start, n, place + number, offset, sequence.window, place + step)
            for number, (sequence, step) in enumerate(zip(sequences, steps, strict=True))
            for (doc, start, n), offset in zip(sequence.pieces, np.cumsum([0, *(p[2] for p in sequence.pieces)]).tolist())
        ]
        doc, start, length, sequence, offset, window, step = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        first = bounds[doc] + start
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
        return pa.table(
            {
                "doc_id": group.column("doc_id").take(pa.array(doc)).combine_chunks(),
                "start": start,
                "length": length,
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": np.diff(bounds)[doc],
                "sequence_id": sequence,
                "offset": offset,
                "window": window.astype(np.int32),
                "step": step,
            }
        )

    return run


def packed_pieces(docs: DataFrame, path: str, end: int, packing: Packing = Packing(), group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Where each piece of each document went; ``path`` is a file of the tokenizers library."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // group_bytes) or 1
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("long")
    return rows.withColumn("packing_group", group).groupBy("packing_group").applyInArrow(_pack_group(path, end, packing), SCHEMA)
