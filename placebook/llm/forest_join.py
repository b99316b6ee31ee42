"""Near-duplicate texts by word n-gram Jaccard similarity, found through a MinHash LSH forest.

A text is the set of its grams of five words; one of fewer words is one gram. Texts of equal word
sequences are one class and are compared once. Each tree of the forest hashes a class's own MinHash
values to one bucket, and classes in a common bucket are candidates: fixed bands (24 of 4 values by
default) in place of sorted prefixes that are shortened. A pair is wanted with one recall at one
threshold, so the depth that meets it is known beforehand, and the pairs under deeper prefixes are
among those at that depth: sorting and shortening would give the same candidates for more hashes.
All candidates of a bucket are compared by their signatures; what is left is gathered into
clusters (components over the surviving pairs), and within a cluster every pair is verified
exactly, in blocks of bounded size that spread over tasks. Pairs never become rows: a block returns
the number of links of each of its texts and a spanning forest.

A text without words has no gram, is linked to nothing and is a group of its own. Equal texts are
linked. Texts are taken whole: a very long one is a slice of its own when it is signed, and makes its block
of verification hold fewer others. A null id is an id like any other; a group is named by its least id. Repeated rows
count as documents. Only doc_id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placebook.llm.components import components
from placebook.llm.shared import free_name, kept, matched
from placebook.llm.words import Texts, mix, slices, texts, words


@dataclass(frozen=True)
class Forest:
    """``floor``: pairs whose signatures agree in less than this share are dropped before
    verification; at the threshold that loses one pair in 10^9. A block of verification holds about
    twice ``verify_block`` texts or ``verify_bytes`` of text, whichever is less."""

    threshold: Fraction = Fraction(4, 5)
    gram: int = 5
    trees: int = 24
    full_depth: int = 4
    recall: float = 0.9999
    floor: float = 0.55
    prefix_block: int = 256
    verify_block: int = 1024
    verify_bytes: int = 16 << 20

    def depth(self) -> int:
        """The longest prefix that reaches the recall for pairs at the threshold."""
        for depth in range(self.full_depth, 0, -1):
            if 1 - (1 - float(self.threshold) ** depth) ** self.trees >= self.recall:
                return depth
        raise ValueError("too few trees for the recall")


def grams(given: Texts, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes of each text with repetitions, bounds per text, and two hashes of its word sequence."""
    found = words(given)
    hashes, bounds = found.hashes(), found.bounds
    count = np.diff(bounds)
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], count)
    left = np.repeat(count, count) - place
    starts = (left >= n) | (place == 0)
    at = np.flatnonzero(starts)
    out = np.zeros(len(at), np.uint64)
    used = np.minimum(left[at], n)
    for k in range(n):  # a shorter text's only gram ends early
        own = hashes[np.minimum(at + k, len(hashes) - 1)] * (used > k)
        out = mix(out + own + np.uint64(0x9E3779B97F4A7C15))
    total = [mix(hashes + mix(place.astype(np.uint64) + np.uint64(seed))) for seed in (1, 1 << 40)]
    sums = []
    for values in total:
        running = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=running[1:])
        sums.append(mix(running[bounds[1:]] - running[bounds[:-1]] + count.astype(np.uint64)))
    return out, np.searchsorted(at, bounds), sums[0], sums[1]


SIGNED = "doc_id long, text_key long, size long, node binary, buckets array<long>, signature binary"


def _sign(forest: Forest, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(20)
        size = forest.trees * forest.full_depth
        a, b = (draw.integers(0, 1 << 31, size, np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
        for batch in slices(batches, "text"):
            hashes, bounds, one, two = grams(texts(batch.column("text")), forest.gram)
            full = np.flatnonzero(np.diff(bounds))
            rows = len(bounds) - 1
            table = np.zeros((rows, size), np.uint32)
            if len(full):
                high, low = (hashes >> np.uint64(32)).astype(np.uint32), hashes.astype(np.uint32)
                for k in range(size):
                    table[full, k] = np.minimum.reduceat(high * a[k] + low * b[k], bounds[full])
            trees = table.reshape(rows, forest.trees, forest.full_depth)
            prefix = np.repeat(np.arange(forest.trees, dtype=np.uint64)[None], rows, 0)
            for k in range(depth):
                prefix = mix(prefix * np.uint64(0x9E3779B97F4A7C15) + trees[:, :, k])
            some = np.zeros(rows, bool)
            some[full] = True
            ends = np.concatenate([[0], np.cumsum(some * forest.trees)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    batch.column("size"),
                    _fixed(np.stack([one, two], 1), some),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix[some].ravel().view(np.int64))),
                    _fixed((table & np.uint32(255)).astype(np.uint8), some),
                ],
                ["doc_id", "text_key", "size", "node", "buckets", "signature"],
            )

    return run


def _fixed(table: np.ndarray, some: np.ndarray) -> pa.Array:
    """Rows of a table as binary values; null where not ``some``."""
    width = table.shape[1] * table.itemsize
    data = np.ascontiguousarray(table)
    plain = pa.Array.from_buffers(pa.binary(width), len(table), [None, pa.py_buffer(data)]).cast(pa.binary())
    return pc.if_else(pa.array(some), plain, pa.scalar(None, pa.binary()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(len(column), width)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        change = np.zeros(table.num_rows, bool)
        for key in keys:
            values = table.column(key).combine_chunks().dictionary_encode().indices.to_numpy()
            change[1:] |= values[1:] != values[:-1]
        edges = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(a, b - a)
        held = table.slice(edges[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each member's component, from a symmetric table of links."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _likely(forest: Forest) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    size = forest.trees * forest.full_depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in grouped(batches, ["bucket", "lo", "hi"]):
            nodes = group.column("node").to_pylist()
            if len(nodes) < 2:
                continue
            own = _matrix(group.column("signature"), size)
            if len(nodes) == 2:
                if (own[0] == own[1]).sum() >= forest.floor * size:
                    a.append(nodes[0])
                    b.append(nodes[1])
            else:
                agree = np.zeros((len(own), len(own)), np.int16)
                for k in range(size):
                    agree += own[:, k, None] == own[None, :, k]
                roots = _roots(agree >= forest.floor * size)
                for i in np.flatnonzero(roots != np.arange(len(roots))).tolist():
                    a.append(nodes[i])
                    b.append(nodes[roots[i]])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _blocks(rows: DataFrame, key: str, chunks: Column) -> DataFrame:
    """Each row once for every pair of chunks that its chunk is part of; chunks are dealt by node."""
    rows = rows.withColumn("chunks", F.greatest(F.ceil(chunks), F.lit(1)).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(9)), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")}).drop("chunks", "other")
    return rows.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def overlaps(owner: np.ndarray, gram: np.ndarray, count: int, slab: int = 2048) -> np.ndarray:
    """Numbers of grams that members have in common, from distinct (owner, gram) with gram sorted.

    Grams of many members are counted by products of dense tables, others pair by pair.
    """
    out = np.zeros((count, count), np.float32)
    firsts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    times = np.diff(np.append(firsts, len(gram)))
    flat = out.reshape(-1)
    for k in range(2, 17):
        own = owner[firsts[times == k][:, None] + np.arange(k)]
        for i in range(k):
            for j in range(k):
                if i != j and len(own):
                    cell, n = np.unique(own[:, i] * count + own[:, j], return_counts=True)
                    flat[cell] += n
    often = np.flatnonzero(times > 16)
    for at in range(0, len(often), slab):
        own = often[at : at + slab]
        dense = np.zeros((count, len(own)), np.float32)
        sizes = times[own]
        where = np.repeat(firsts[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        dense[owner[where], np.repeat(np.arange(len(own)), sizes)] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def distinct_grams(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, gram) without repetitions, sorted by gram; and the number of grams of each text."""
    parts = []
    base = 0
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    for some in slices(iter([batch]), "text"):
        hashes, bounds, _, _ = grams(texts(some.column("text")), n)
        parts.append((hashes, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) + base))
        base += some.num_rows
    gram, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((owner, gram))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[new], owner[new]
    return owner, gram, np.bincount(owner, minlength=len(column))


LINKED = "node binary, root binary, text_links long, doc_links long"


def _verify(forest: Forest) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    p, q = forest.threshold.numerator, forest.threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["cluster", "lo", "hi"]):
            nodes = group.column("node").to_pylist()
            # A row that the table holds twice may come twice.
            first = np.unique(np.array(nodes, object), return_index=True)[1]
            if len(first) < len(nodes):
                group = group.take(pa.array(first))
                nodes = group.column("node").to_pylist()
            if len(nodes) < 2:
                continue
            owner, gram, sizes = distinct_grams(group.column("text").combine_chunks(), forest.gram)
            common = overlaps(owner, gram, len(nodes))
            linked = q * common >= p * (sizes[:, None] + sizes[None, :] - common)
            chunk = group.column("chunk").to_numpy()
            if group.column("lo")[0] != group.column("hi")[0]:
                linked &= chunk[:, None] != chunk[None, :]  # pairs within a chunk have a block of their own
            np.fill_diagonal(linked, False)
            roots = _roots(linked)
            copies = group.column("copies").to_numpy()
            yield pa.RecordBatch.from_pydict(
                {
                    "node": pa.array(nodes, pa.binary()),
                    "root": pa.array([nodes[r] for r in roots.tolist()], pa.binary()),
                    "text_links": linked.sum(1),
                    "doc_links": linked @ copies,
                }
            )

    return run


def joined(docs: DataFrame, folder: str, forest: Forest = Forest()) -> DataFrame:
    """For each row of ``docs``: its group of linked documents, and its number of links.

    (doc_id, class_id, n_links, n_text_links, text_key, class_key): ``n_links`` counts the other documents at
    the threshold or above, copies included; ``n_text_links`` the different texts among them.
    ``class_id`` is the least doc_id that chains of links reach, ``class_key`` the key of its text.
    """
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    signed = kept(rows.withColumn("size", size).mapInArrow(_sign(forest, forest.depth()), SIGNED), f"{folder}/signed")
    with_words = signed.where("node is not null")
    classes = kept(
        with_words.groupBy("node").agg(
            F.count("*").alias("copies"),
            F.min(F.struct("doc_id", "text_key")).alias("first"),
            F.first("size").alias("size"),
            F.first("buckets").alias("buckets"),
            F.first("signature").alias("signature"),
        ),
        f"{folder}/classes",
    )

    # Candidates: classes that share a prefix in some tree.
    places = classes.select("node", F.explode("buckets").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = places.join(shared, "bucket").join(classes.select("node", "signature"), "node")
    likely = _blocks(members, "bucket", F.col("members") / forest.prefix_block).select("bucket", "lo", "hi", "node", "signature")
    pairs = likely.mapInArrow(_likely(forest), "a binary, b binary")
    clusters = kept(
        components(pairs, f"{folder}/candidates").withColumnRenamed("component", "cluster"), f"{folder}/clusters"
    )

    # Verification: one text of each class, block by block within a cluster.
    clusters = clusters.join(classes.select("node", "copies", "first", "size"), "node")
    sizes = clusters.groupBy("cluster").agg(
        F.greatest(F.count("*") / forest.verify_block, F.sum("size") / forest.verify_bytes).alias("parts")
    )
    wanted = (
        clusters.join(sizes, "cluster")
        .select("node", "cluster", "parts", "copies", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    blocks = _blocks(rows.join(wanted, same), "cluster", F.col("parts"))
    verified = kept(
        blocks.select("cluster", "lo", "hi", "chunk", "node", "copies", "text").mapInArrow(_verify(forest), LINKED),
        f"{folder}/verified",
    )
    groups = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")), f"{folder}/links")
    links = verified.groupBy("node").agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"))
    told = (
        classes.select("node", "copies", "first")
        .join(links, "node", "left")
        .join(groups, "node", "left")
        .select(
            "node",
            F.coalesce("component", "node").alias("component"),
            "first",
            (F.col("copies") - 1 + F.coalesce("doc_links", F.lit(0))).alias("n_links"),
            F.coalesce("text_links", F.lit(0)).cast("long").alias("n_text_links"),
        )
    )
    told = kept(told, f"{folder}/told")
    named = told.groupBy("component").agg(F.min("first").alias("head"))
    told = told.join(named, "component").select("node", "head", "n_links", "n_text_links")
    nothing = F.lit(0).cast("long")
    return (
        signed.select("doc_id", "text_key", "node")
        .join(told, "node", "left")
        .select(
            "doc_id",
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
            F.coalesce("n_links", nothing).alias("n_links"),
            F.coalesce("n_text_links", nothing).alias("n_text_links"),
            "text_key",
            F.when(F.col("node").isNull(), F.col("text_key")).otherwise(F.col("head.text_key")).alias("class_key"),
        )
    )


def survivors(docs: DataFrame, folder: str, forest: Forest = Forest()) -> DataFrame:
    """One row of ``docs`` of each group, the one of least doc_id, with all its columns.

    Of rows that repeat id and text one stays. Texts without words all stay.
    """
    verdicts = kept(joined(docs, folder, forest), f"{folder}/verdicts")
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))
    heads = verdicts.where(first).groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"))
    heads = kept(heads, f"{folder}/heads")
    once = matched(docs, heads.where("rows = 1"), "left_semi")
    if not heads.where("rows > 1").limit(1).count():
        return once
    # A window gives one of several equal rows; it sorts only rows that repeat.
    again = matched(docs, heads.where("rows > 1"), "left_semi")
    with_words = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     ")) != ""
    # Maps and the like have no order of their own; their text has one.
    rest = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns if c not in ("doc_id", "text")]
    copy, place = Window.partitionBy("doc_id", "text").orderBy(*rest, "doc_id"), free_name(docs, "copy")
    one = again.where(with_words).withColumn(place, F.row_number().over(copy)).where(F.col(place) == 1).drop(place)
    return once.unionByName(one).unionByName(again.where(~with_words))
