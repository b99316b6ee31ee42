"""Sharding through a fixed number of virtual slots.

Every record is hashed into one of a few thousand slots by its id, for ever. A stored, versioned
map gives each slot to a shard. A run loads the newest version, measures the bytes of the slots and
edits the map: whole slots move from full shards to empty ones, and everything else stays where
it is. An edited map is stored as the next version, so data that grew a little moves a little. The
law kept is ``bytes``: the shards' sizes are near equal.

Null texts have no bytes. A record without an id is hashed by its text, so that such records spread.
Repeated rows are placed like any other row; rows with equal ids share a slot, as the law of slots
asks, and so do equal texts without an id. Positions within a shard follow slot, id, checksum and
size, so only rows alike in all of these can swap places. A very long text counts with all its bytes
and is not cut; its shard is as much larger as no trade of slots can even out. Further columns are not read, and an
empty table gives an empty result with a map for no bytes.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placebook.llm.shared import fresh_folder, kept
from placebook.session import has_files

#: Number of slots; never changes for a data set. A map of this many entries fits anywhere.
SLOTS = 8192
ROW_BYTES = 8


@dataclass(frozen=True)
class SlotMap:
    """``shards[slot]`` is the shard of a slot."""

    version: int
    shards: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        listed = F.split(F.lit(",".join(map(str, self.shards))), ",")
        return spark.range(1).select(F.posexplode(listed).alias("virtual_slot", "shard")).select(
            "virtual_slot", F.col("shard").cast("int").alias("shard"), F.lit(self.version).alias("map_version")
        )

    def save(self, spark: SparkSession, folder: str) -> None:
        """Store this version beside the earlier ones; none is overwritten."""
        self.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={self.version}")

    @staticmethod
    def newest(spark: SparkSession, folder: str) -> SlotMap | None:
        """The last version that was stored whole; None where there is none."""
        if not has_files(spark, f"{folder}/version=*/_SUCCESS"):
            return None
        return SlotMap.load(spark, folder, spark.read.parquet(folder).agg(F.max("version")).first()[0])

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{folder}/version={version}").orderBy("virtual_slot").collect()
        return SlotMap(version, tuple(row.shard for row in rows))


def first_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """Equal ranges of slots, before any record is known."""
    return SlotMap(0, tuple(slot * shards // slots for slot in range(slots)))


def rebalanced(before: SlotMap, sizes: list[int], shards: int, tolerance: float = 1e-4) -> SlotMap:
    """The next version: slots move, or trade places, between the fullest and the emptiest shard
    until their sizes differ by at most ``tolerance`` of the mean or no trade helps.

    Works on the fixed number of slots only, whatever the data.
    """
    # Slots of shards that are given up go anywhere first.
    now = [shard if shard < shards else slot % shards for slot, shard in enumerate(before.shards)]
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(now):
        own[shard].append((sizes[slot], slot))
    load = [sum(size for size, _ in slots) for slots in own]
    for slots in own:
        slots.sort()
    enough = tolerance * sum(load) / shards
    for _ in range(4 * len(now)):
        full, empty = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[empty]
        if gap <= enough:
            break
        best = None
        for back in [(0, -1), *own[empty]]:  # giving nothing back is a plain move
            at = bisect_left(own[full], (back[0] + gap / 2, -1))
            for give in own[full][max(0, at - 1) : at + 1]:
                gain = give[0] - back[0]
                if 0 < gain < gap and (best is None or abs(gap - 2 * gain) < best[0]):
                    best = (abs(gap - 2 * gain), give, back)
        if best is None:
            break
        for (size, slot), source, target in ((best[1], full, empty), (best[2], empty, full)):
            if slot >= 0:
                own[source].remove((size, slot))
                insort(own[target], (size, slot))
                load[source] -= size
                load[target] += size
                now[slot] = target
    return SlotMap(before.version + 1, tuple(now))


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select("doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64(data)).otherwise(F.xxhash64(F.col("doc_id").cast("long"))), F.lit(slots))
        .cast("int")
        .alias("virtual_slot"),
    )


def slot_sizes(slotted: DataFrame) -> DataFrame:
    """Rows and bytes of each slot that has records."""
    return slotted.groupBy("virtual_slot").agg(F.count("*").alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def sharded(docs: DataFrame, shards: int, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Shard and position of every record, by the map stored in ``folder``, which is edited first.

    ``from_shard`` is where the record's slot was under the version before, so the rows to be moved are
    those where it differs. A folder without a map starts with equal ranges of slots as version 0.
    """
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "slots")
    start = SlotMap.newest(spark, f"{folder}/map")
    if start is None:
        start = first_map(shards, slots)
        start.save(spark, f"{folder}/map")
    if len(start.shards) != slots:
        raise ValueError(f"the map in {folder} has {len(start.shards)} slots, and their number never changes")
    slotted = kept(with_slots(docs, slots), f"{folder}/records-{uuid.uuid4().hex}")
    by_slot = slot_sizes(slotted)
    sizes = [0] * slots
    for row in by_slot.collect():  # one row per slot: a fixed number
        sizes[row.virtual_slot] = row.slot_bytes
    used = rebalanced(start, sizes, shards)
    if used.shards == start.shards and start.version:
        used = start
    else:
        used.save(spark, f"{folder}/map")
    moved = start.frame(spark).select("virtual_slot", F.col("shard").alias("from_shard"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = used.frame(spark).join(moved, "virtual_slot").join(by_slot, "virtual_slot").select(
        "virtual_slot", "shard", "from_shard", "map_version", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        slotted.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(bases), "virtual_slot")  # at most one row per slot
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("rank")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            "map_version",
            "from_shard",
        )
    )
