"""Hard negatives: rows of another label that score a little less than an anchor's own positives.

Scores are inner products of whole numbers and come out exactly. Most pairs are told apart without
computing them. Each vector, made a unit vector and rotated, is coded in one bit per component: the
signs, as a unit vector c1, with the stored alignment a1 = <v, c1>. What is left, v - a1 c1, is coded the
same way, and so on for ``levels`` codes; the length of the last rest is stored too. An anchor's rotated
vector is rounded to ``planes`` bits per component and split into bit planes, so its product with a code
is a sum of popcounts, off by no more than the length of the rounding error. So

    <anchor, v> = sum of a_l <anchor, c_l>  +  <anchor, rest>,

where the rest is at right angles to the last code: by Cauchy-Schwarz the last term is at most
the length of the rest times that of the part of the anchor at right angles to the code. That gives
each pair an interval that holds its score for certain. A pair stays only if its interval reaches the
wanted range and the 5th best lower end seen; survivors are scored in integers.

Rows are stored with their codes and dealt into blocks by row number, anchors into groups by a hash;
a task holds one block and one group at a time. A block returns its best rows
per anchor, which are then ranked over all blocks. No label and no vector is a key, so a hot label
or many equal vectors spread like any other rows, and no candidate is left out.

Rows with a null vec_id, label or vector, or with a null or non-finite component take no part; neither do
rows with a component of 2**16 or more, so that scores fit 64 bits. Repeated rows (id, label and whole
components equal) are one row; rows that share only the id are different rows. Shorter vectors end in
zeros, an empty vector is all zeros and scores 0. Ties go to the smaller vec_id. Further columns are not
read. An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placebook.llm.shared import kept


@dataclass(frozen=True)
class Search:
    """Which rows are anchors and how many positives and negatives each gets.

    Negatives score at least ``low`` percent of the positive and at most as much. ``levels``,
    ``planes`` and ``seed`` set the codes; ``block_rows`` (least and most rows, a 256th of the table in
    between) and ``group_anchors`` say what a task holds. None of these changes the result.
    """

    every: int = 100
    positives: int = 5
    negatives: int = 5
    low: int = 80
    levels: int = 5
    planes: int = 7
    seed: int = 1
    block_rows: tuple[int, int] = (4096, 65536)
    group_anchors: int = 4096


#: Numbers that one step of a search holds at once, and room for rounding in the ends of intervals.
STEP, SLACK = 1 << 20, 1e-9


def participants(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, whole): labels as mined, components as whole numbers."""
    value = F.col(vector).cast("array<double>")
    whole = F.transform(value, lambda x: F.floor(x * 256).cast("int"))
    sound = F.forall(value, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float(1 << 16))))  # NaN counts as the greatest
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), value.alias(vector))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & sound)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), whole.alias("whole")).distinct()


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows turned by random signs and Walsh-Hadamard transforms, three times; lengths are kept."""
    rng, size = np.random.default_rng(seed), x.shape[1]
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], size)
        step = 1
        while step < size:
            pairs = x.reshape(len(x), -1, 2, step)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), size)
            step *= 2
        x = x / np.sqrt(size)
    return x


def codes(whole: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits per level (rows, levels, words), alignments per level, and lengths of vector and rest."""
    length = np.sqrt((whole.astype(float) ** 2).sum(1))
    rest = rotated(whole / np.maximum(length, 1)[:, None], search.seed)
    bits, aligned = [], []
    for _ in range(search.levels):
        sign = rest >= 0
        aligned.append(np.abs(rest).sum(1) / np.sqrt(rest.shape[1]))
        rest = rest - aligned[-1][:, None] * np.where(sign, 1, -1) / np.sqrt(rest.shape[1])
        bits.append(np.packbits(sign, axis=1, bitorder="little").view(np.uint64))
    left = np.sqrt((rest**2).sum(1))
    return np.stack(bits, 1), np.stack(aligned, 1), np.stack([length, left], 1)


CODED = "vec_id long, label long, whole binary, bits binary, aligned binary, lengths binary"


def coded(rows: DataFrame, size: int, search: Search) -> DataFrame:
    """Rows with their codes; ``size``: components of a vector, a power of two of 64 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column("whole")
                per = np.diff(lists.offsets.to_numpy())
                whole = np.zeros((part.num_rows, size), np.int32)
                starts = np.repeat(np.cumsum(per) - per, per)
                whole[np.repeat(np.arange(len(per)), per), np.arange(per.sum()) - starts] = lists.flatten().to_numpy()
                columns = [pa.array([x.tobytes() for x in values], pa.binary()) for values in (whole, *codes(whole, search))]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), *columns], [f.split()[0] for f in CODED.split(", ")])

    return rows.mapInArrow(run, CODED)


def matrix(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """A column of equally long binaries as rows of numbers."""
    column = table.column(name).combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


@dataclass
class Block:
    """Rows as arrays."""

    row_no: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    whole: np.ndarray
    bits: np.ndarray
    aligned: np.ndarray
    length: np.ndarray
    left: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, search: Search) -> Block:
        lengths = matrix(table, "lengths", np.float64)
        bits = matrix(table, "bits", np.uint64).reshape(table.num_rows, search.levels, -1)
        numbers = [table.column(name).to_numpy() for name in ("row_no", "vec_id", "label")]
        return cls(*numbers, matrix(table, "whole", np.int32), bits, matrix(table, "aligned", np.float64), lengths[:, 0], lengths[:, 1])

    def part(self, at: np.ndarray) -> Block:
        return Block(*(getattr(self, name)[at] for name in self.__dataclass_fields__))


def intervals(anchors: Block, rows: Block, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the score of each anchor (line) with each row (column)."""
    size = anchors.whole.shape[1]
    unit = rotated(anchors.whole / np.maximum(anchors.length, 1)[:, None], search.seed)
    low = unit.min(1)
    step = np.maximum((unit.max(1) - low) / ((1 << search.planes) - 1), 1e-30)
    level = np.rint((unit - low[:, None]) / step[:, None]).astype(np.int64)
    off = np.sqrt(((unit - low[:, None] - level * step[:, None]) ** 2).sum(1))
    planes = [np.packbits((level >> p & 1).astype(bool), axis=1, bitorder="little").view(np.uint64) for p in range(search.planes)]
    total = level.sum(1)
    middle = np.zeros((len(unit), len(rows.vec_id)))
    blur = np.zeros_like(middle)
    for k in range(search.levels):
        signs = rows.bits[:, k]
        set_bits = np.bitwise_count(signs).sum(1, dtype=np.int64)
        picked = np.zeros(middle.shape, np.int32)  # levels under the set bits, plane by plane
        for p, plane in enumerate(planes):
            for word in range(signs.shape[1]):
                picked += np.bitwise_count(plane[:, word][:, None] & signs[:, word][None]).astype(np.int32) << p
        product = step[:, None] * (2 * picked - total[:, None]) + low[:, None] * (2 * set_bits - size)[None]
        product /= np.sqrt(size)
        middle += product * rows.aligned[:, k][None]
        blur += rows.aligned[:, k][None]
    blur *= off[:, None]
    # The rest is at right angles to the last code, whose product with the anchor is ``product`` up to ``off``.
    across = np.sqrt(np.clip(1 - np.maximum(np.abs(product) - off[:, None], 0) ** 2, 0, 1))
    half = (blur + across * rows.left[None] + SLACK) * (scale := anchors.length[:, None] * rows.length[None])
    middle *= scale
    return middle - half, middle + half


def kth_best(values: np.ndarray, able: np.ndarray, k: int) -> np.ndarray:
    """Per line the k-th greatest of the able values; minus infinity if there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return -np.partition(np.where(able, -values, np.inf), k - 1, axis=1)[:, k - 1]


def exact(anchors: Block, rows: Block, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(line), np.int64)
    step = max(1, STEP // rows.whole.shape[1])
    for lo in range(0, len(line), step):
        a, b = anchors.whole[line[lo : lo + step]].astype(np.int64), rows.whole[at[lo : lo + step]].astype(np.int64)
        out[lo : lo + step] = (a * b).sum(1)
    return out


def first_of(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row_no: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group by falling score, then vec_id."""
    order = np.lexsort((row_no, vec_id, -score, group))
    sorted_group = group[order]
    begins = np.searchsorted(sorted_group, sorted_group, side="left")
    return order[np.arange(len(order)) - begins < most]


FOUND = "anchor_no long, anchor_id long, wanted long, score long, found_id long, found_no long"


def _found(anchors: Block, rows: Block, line: np.ndarray, wanted: np.ndarray, at: np.ndarray, score: np.ndarray) -> dict:
    return dict(
        anchor_no=anchors.row_no[line], anchor_id=anchors.vec_id[line], wanted=wanted, score=score, found_id=rows.vec_id[at], found_no=rows.row_no[at]
    )


def _steps(anchors: Block, rows: Block) -> Iterator[Block]:
    size = max(1, STEP // max(1, len(rows.vec_id)))
    for lo in range(0, len(anchors.vec_id), size):
        yield anchors.part(np.arange(lo, min(lo + size, len(anchors.vec_id))))


def nearest_of_label(anchors: Block, rows: Block, search: Search) -> Iterator[dict]:
    """The best rows of each anchor's own label within the block."""
    for label in np.unique(anchors.label):
        own = rows.part(np.flatnonzero(rows.label == label))
        if not len(own.vec_id):
            continue
        for some in _steps(anchors.part(np.flatnonzero(anchors.label == label)), own):
            able = some.row_no[:, None] != own.row_no[None]
            low, high = intervals(some, own, search)
            line, at = np.nonzero(able & (high >= kth_best(low, able, search.positives)[:, None]))
            score = exact(some, own, line, at)
            best = first_of(line, score, own.vec_id[at], own.row_no[at], search.positives)
            yield _found(some, own, line[best], np.full(len(best), -1), at[best], score[best])


def below_positives(anchors: Block, positives: np.ndarray, rows: Block, search: Search) -> Iterator[dict]:
    """Per anchor and positive the best rows of other labels in range, within the block.

    ``positives``: a line of (anchor row, positive score) per pair wanted.
    """
    place = {int(no): i for i, no in enumerate(anchors.row_no)}
    owner = np.array([place[int(no)] for no in positives[:, 0]], np.int64)
    for some in _steps(anchors, rows):
        first = place[int(some.row_no[0])]
        able = some.label[:, None] != rows.label[None]
        low, high = intervals(some, rows, search)
        mine = np.flatnonzero((owner >= first) & (owner < first + len(some.vec_id)))
        pairs, lines = [], []
        for pair in mine:
            i, best = owner[pair] - first, positives[pair, 1]
            floor = search.low * best / 100
            stays = able[i] & (high[i] >= floor) & (low[i] <= best)
            sure = stays & (low[i] >= floor) & (high[i] <= best)
            if sure.sum() >= search.negatives:
                stays &= high[i] >= -np.partition(-low[i][sure], search.negatives - 1)[search.negatives - 1]
            lines.append(np.flatnonzero(stays))
            pairs.append(np.full(len(lines[-1]), pair))
        if not pairs:
            continue
        at, pair = np.concatenate(lines), np.concatenate(pairs)
        # A row may stay for several positives of an anchor; it is scored once.
        line = owner[pair] - first
        cell, back = np.unique(line * len(rows.vec_id) + at, return_inverse=True)
        score = exact(some, rows, cell // len(rows.vec_id), cell % len(rows.vec_id))[back]
        best = positives[pair, 1]
        least = np.array([-(-search.low * int(b) // 100) for b in positives[:, 1]], np.int64)[pair]
        fits = np.flatnonzero((least <= score) & (score <= best))
        at, pair, line, score = at[fits], pair[fits], line[fits], score[fits]
        first_ones = first_of(pair, score, rows.vec_id[at], rows.row_no[at], search.negatives)
        yield _found(some, rows, line[first_ones], positives[pair[first_ones], 1], at[first_ones], score[first_ones])


def _table(parts: Iterator[dict]) -> pa.Table:
    names = [field.split()[0] for field in FOUND.split(", ")]
    held = [*parts, {name: np.zeros(0, np.int64) for name in names}]
    return pa.table({name: np.concatenate([part[name] for part in held]).astype(np.int64) for name in names})


def paired(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int, work: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """``work`` on every block of rows with every group of anchors."""

    def both(block: pa.Table, group: pa.Table) -> pa.Table:
        return work(block, group) if block.num_rows and group.num_rows else _table(iter(()))

    # A pair of blocks is little data and much work, so that the number of tasks follows the pairs.
    tasks = min(2 * blocks * groups, 100_000)
    dealt = rows.withColumn("block", F.pmod("row_no", F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.repartition(tasks, "block", "group")
    asked = anchors.withColumn("group", F.pmod(F.xxhash64("row_no"), F.lit(groups)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return dealt.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInArrow(both, FOUND)


def best_of_all(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "found_id", "found_no")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined(vectors: DataFrame, folder: str, search: Search = Search(), vector: str = "embedding") -> DataFrame:
    """Hard negatives of every anchor (vec_id divisible by ``every``) and each of its positives."""
    spark = vectors.sparkSession
    rows = kept(participants(vectors, vector), f"{folder}/rows")
    is_anchor: Column = F.col("vec_id") % search.every == 0
    told = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("whole")).alias("size")).first()
    if not told.anchors:
        return spark.createDataFrame([], MINED)
    size = max(64, 1 << (max(1, told.size) - 1).bit_length())
    rows = kept(coded(rows, size, search).withColumn("row_no", F.monotonically_increasing_id()), f"{folder}/codes")
    # Read once more: columns that both sides of a cogroup share by origin would be left out of one of them.
    anchors = spark.read.schema(rows.schema).parquet(f"{folder}/codes").where(is_anchor)
    block_rows = min(max(search.block_rows[0], told.n // 256), search.block_rows[1])
    blocks, groups = -(-told.n // block_rows), -(-told.anchors // search.group_anchors)

    def near(block: pa.Table, group: pa.Table) -> pa.Table:
        return _table(nearest_of_label(Block.of(group, search), Block.of(block, search), search))

    positives = best_of_all(paired(rows, anchors, blocks, groups, near), ["anchor_no"], search.positives)
    positives = kept(positives.select("anchor_no", "anchor_id", "place", "found_id", "score"), f"{folder}/positives")
    # At most ``positives`` scores per anchor.
    scores = positives.groupBy(F.col("anchor_no").alias("row_no")).agg(F.collect_set("score").alias("scores"))
    asked = anchors.join(scores, "row_no")

    def below(block: pa.Table, group: pa.Table) -> pa.Table:
        lists = group.column("scores").combine_chunks()
        owner = np.repeat(group.column("row_no").to_numpy(), np.diff(lists.offsets.to_numpy()))
        wanted = np.stack([owner, lists.flatten().to_numpy()], 1)
        return _table(below_positives(Block.of(group, search), wanted, Block.of(block, search), search))

    found = best_of_all(paired(rows, asked, blocks, groups, below), ["anchor_no", "wanted"], search.negatives)
    negatives = found.select("anchor_no", F.col("wanted").alias("score"), F.col("place").alias("rank"), F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, ["anchor_no", "score"]).select(
        "anchor_id",
        F.col("found_id").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        "negative_id",
        F.col("score").alias("positive_score"),
        "negative_score",
    )
