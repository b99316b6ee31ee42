"""Token ids of a corpus in binary files whose document boundaries take a few bits each.

A file holds the ids of a range of documents back to back, in ascending doc_id order, in 2 bytes
each where the vocabulary allows it, else in 4. Boundaries and document ids are non-decreasing
numbers and are stored in Elias-Fano form: the low bits of each as they are, the high bits in unary
in a bit vector, with the place of every 512th one as a select table of 32-bit entries. That
takes about two bits more than the low bits, for any number of ids, and no 64-bit table. The
structures follow the ids, so that a file is written in one pass with only its boundaries in
memory.

Layout (little endian): ids, boundaries, document ids, footer. Null document ids come first and
are counted in the footer. Null texts are empty; every document has its end id. Documents with
equal ids follow each other, ordered by text. A text of any length is encoded whole, a few megabytes
of texts at a time, a longer one by itself. Further columns are not read. An empty table gives
no file.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.llm.chunked_ids import encoder, with_end
from placebook.llm.shared import file_system, kept
from placebook.llm.words import slices, texts

MAGIC = b"EFIDS001"
#: Footer: magic, bytes per id, documents, ids, null document ids, place of the boundaries, of the document ids.
FOOTER = "<8sQQQQQQ"
#: Head of a structure: numbers, universe, least, low bits each, bytes of low bits, of high bits, of the select table.
HEAD = "<QQqQQQQ"
EVERY = 512


def pack(values: np.ndarray) -> bytes:
    """Non-decreasing 64-bit numbers in Elias-Fano form."""
    count = len(values)
    least = int(values[0]) if count else 0
    x = (values - least).astype(np.uint64)
    universe = int(x[-1]) + 1 if count else 0
    bits = max(0, (universe // max(count, 1)).bit_length() - 1)
    low = ((x[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (x >> np.uint64(bits)).astype(np.int64) + np.arange(count)
    high = np.zeros(int(ones[-1]) + 1 if count else 0, np.uint8)
    high[ones] = 1
    if len(high) >= 1 << 32:
        raise ValueError("too many documents in a file; use more shards")
    parts = [np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::EVERY].astype("<u4").tobytes()]
    return struct.pack(HEAD, count, universe, least, bits, *map(len, parts)) + b"".join(parts)


class Packed:
    """Reads what ``pack`` wrote."""

    def __init__(self, data: bytes) -> None:
        self.count, self.universe, self.least, self.bits, *sizes = struct.unpack_from(HEAD, data)
        first = struct.calcsize(HEAD)
        a, b = first + sizes[0], first + sizes[0] + sizes[1]
        whole = np.frombuffer(data, np.uint8)
        self.low, self.high = whole[first:a], whole[a:b]
        self.samples = np.frombuffer(data, "<u4", sizes[2] // 4, b)

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.bits:
            return np.zeros(last - first, np.int64)
        a = first * self.bits
        own = np.unpackbits(self.low[a // 8 : (last * self.bits + 7) // 8], bitorder="little")[a % 8 :]
        table = own[: (last - first) * self.bits].reshape(last - first, self.bits)
        return table.astype(np.int64) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))

    def select(self, first: int, last: int | None = None) -> np.ndarray:
        """Numbers first to last - 1; reads only the bits from the sample before to the sample after."""
        last = first + 1 if last is None else last
        if last <= first:
            return np.zeros(0, np.int64)
        sample = first // EVERY
        place = int(self.samples[sample])
        after = -(-last // EVERY)
        to = int(self.samples[after]) + 1 if after < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[place // 8 : (to + 7) // 8], bitorder="little")
        bits[: place % 8] = 0
        ones = np.flatnonzero(bits) + place // 8 * 8
        skip = first - sample * EVERY
        high = ones[skip : skip + last - first] - np.arange(first, last)
        return (high << self.bits | self._low(first, last)) + self.least


@dataclass(frozen=True)
class Tokens:
    """How ids are made: a file of the tokenizers library, the end id, and bytes per id."""

    path: str
    end: int
    width: int = 2

    @property
    def kind(self) -> str:
        return f"<u{self.width}"


def _writer(folder: str, tokens: Tokens) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An executor may keep more workers than run at a time; those that wait hold few chunks.
        own = encoder(tokens.path)
        try:
            yield from written(batches, own.ids)
        finally:
            own.forget()
            pa.default_memory_pool().release_unused()

    def written(batches: Iterator[pa.RecordBatch], encode: Callable) -> Iterator[pa.RecordBatch]:
        system, top = file_system(folder)
        system.create_dir(top, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.ids"
        trial = posixpath.join(top, f"{name}.{uuid.uuid4().hex}")
        out, ends, doc_ids, nulls, total = None, [np.zeros(1, np.int64)], [], 0, 0
        for batch in slices(batches, "text"):
            ids, bounds = with_end(*encode(texts(batch.column("text"))), tokens.end)
            if len(ids) and int(ids.max()) >= 1 << 8 * tokens.width:
                raise ValueError("an id does not fit in the width")
            out = out or system.open_output_stream(trial)
            out.write(ids.astype(tokens.kind).tobytes())
            ends.append(bounds[1:] + total)
            total += len(ids)
            nulls += batch.column("doc_id").null_count
            doc_ids.append(batch.column("doc_id").drop_null().to_numpy())
        if out is None:
            return
        known = np.concatenate(doc_ids)
        structures = pack(np.concatenate(ends)), pack(known)
        at = total * tokens.width
        out.write(b"".join(structures))
        out.write(struct.pack(FOOTER, MAGIC, tokens.width, nulls + len(known), total, nulls, at, at + len(structures[0])))
        out.close()
        # Written under another name first: a task that runs twice leaves one whole file.
        system.move(trial, posixpath.join(top, name))
        first = int(known[0]) if not nulls else None
        yield pa.RecordBatch.from_pydict(
            {"name": [name], "first_id": pa.array([first], pa.int64()), "n_docs": [nulls + len(known)], "n_ids": [total]}
        )

    return write


def write(docs: DataFrame, folder: str, tokens: Tokens, shards: int | None = None) -> list:
    """Write ``docs`` (doc_id, text) to files below ``folder``; one row per file, in order.

    Documents are dealt out by ranges of doc_id, so files in the order of their first document are
    the corpus in the order of doc_id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(shards, "doc_id") if shards else rows.repartitionByRange("doc_id")
    written = dealt.sortWithinPartitions("doc_id", "text").mapInArrow(
        _writer(folder, tokens), "name string, first_id long, n_docs long, n_ids long"
    )
    manifest = kept(written, f"{folder}/manifest")
    return sorted(manifest.collect(), key=lambda r: (r.first_id is not None, r.first_id))  # one row per file


class File:
    """Random access to one file; reads what is asked for only."""

    def __init__(self, folder: str, name: str) -> None:
        system, top = file_system(folder)
        path = posixpath.join(top, name)
        self.file = system.open_input_file(path)
        last = self.file.size() - struct.calcsize(FOOTER)
        footer = struct.unpack(FOOTER, self._read(last, struct.calcsize(FOOTER)))
        magic, self.width, self.n_docs, self.n_ids, self.nulls, at, ids_at = footer
        if magic != MAGIC:
            raise ValueError(f"{path} is not a file of ids")
        self.bounds = Packed(self._read(at, ids_at - at))
        self.doc_ids = Packed(self._read(ids_at, last - ids_at))

    def _read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def doc_id(self, n: int) -> int | None:
        return None if n < self.nulls else int(self.doc_ids.select(n - self.nulls)[0])

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids number first to last - 1 of the file."""
        return np.frombuffer(self._read(first * self.width, (last - first) * self.width), f"<u{self.width}")

    def document(self, n: int) -> np.ndarray:
        return self.ids(*self.bounds.select(n, n + 2).tolist())


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def told(file: File, base: int, at: int, to: int) -> pa.RecordBatch:
        bounds = file.bounds.select(at, to + 1)
        ids = file.ids(int(bounds[0]), int(bounds[-1])).astype("<u4")
        own = (bounds - bounds[0]).tolist()
        known = file.doc_ids.select(max(0, at - file.nulls), max(0, to - file.nulls))
        doc_ids = [None] * (to - at - len(known)) + known.tolist()
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "start": bounds[:-1] + base,
                "n_tokens": np.diff(bounds),
                "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(own[:-1], own[1:], strict=True)], pa.int64()),
            }
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = File(folder, row["name"])
                for at in range(0, file.n_docs, 1000):
                    yield told(file, row["base"], at, min(file.n_docs, at + 1000))

    return read


def read_back(docs: DataFrame, folder: str, files: list) -> DataFrame:
    """Every document of the files: where it starts in the corpus, its length and its checksum."""
    spark, rows, base = docs.sparkSession, [], 0
    for file in files:
        rows.append((file.name, base))
        base += file.n_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    listed = spark.createDataFrame(rows, "name string, base long")
    return listed.repartition(max(1, len(rows))).mapInArrow(_reader(folder), schema)
