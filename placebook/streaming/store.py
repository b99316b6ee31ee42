"""A directory that grows by batches, in parts that are merged and removed.

Each batch adds a part: its winners, one row per business, and what it rejected. When
``merge_every`` parts of one level are there, they become one part of the next level, which
holds one row per business again. So a row is written once per level, there are about
``merge_every`` parts of each level, and the number of levels is the logarithm of the number of
batches: what a batch costs on average hardly grows with the store, and a reader opens few parts.
Rewriting hash buckets of the key instead would rewrite the whole store, as a batch of a few
thousand businesses touches every bucket.

The manifest says which parts hold. Every change writes a new version of it, and readers take
the newest, so a batch is in the store as a whole or not at all. Parts that were merged stay for
``retain`` versions, for readers that took an older one, and are then removed. A batch that comes again
replaces what its first try left, or is left out if that was finished. A store belongs to one stream.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession

from placebook.operators.dedupe import dedupe, duplicate_numbers, merge_winners
from placebook.operators.normalise import listings, normalise, rejected
from placebook.operators.rollup import by_state, one_row, readable_files
from placebook.plans.directory import Directory, standardise_contacts
from placebook.session import has_files, remove
from placebook.sinks.exports import export

ORDER = ["file", "pos"]


@dataclass(frozen=True)
class Part:
    """``files``: readable documents it stands for. ``retired``: version that no longer has it."""

    name: str
    level: int
    files: int
    retired: int | None = None


@dataclass(frozen=True)
class Manifest:
    version: int
    last_batch: int
    parts: tuple[Part, ...]

    def live(self, level: int | None = None) -> list[Part]:
        return [p for p in self.parts if p.retired is None and level in (None, p.level)]


_MANIFEST_SCHEMA = "last_batch long, name string, level int, files long, retired long"


def manifest(spark: SparkSession, store: str) -> Manifest:
    """The newest state of a store; version 0 of one that does not exist yet."""
    if not has_files(spark, f"{store}/manifest/version=*/_SUCCESS"):
        return Manifest(0, -1, ())
    versions = spark.read.schema(f"{_MANIFEST_SCHEMA}, version long").parquet(f"{store}/manifest")
    # One row per part, of the few versions that are kept.
    rows = versions.collect()
    version = max(row.version for row in rows)
    newest = [row for row in rows if row.version == version]
    parts = tuple(Part(r.name, r.level, r.files, r.retired) for r in sorted(newest, key=lambda r: r.name) if r.name is not None)
    return Manifest(version, newest[0].last_batch, parts)


def _commit(spark: SparkSession, store: str, state: Manifest, retain: int) -> None:
    """Remove what no kept version needs, then write the next version."""
    version = state.version + 1
    parts = [replace(p, retired=version) if p.retired == 0 else p for p in state.parts]
    for part in [p for p in parts if p.retired is not None and p.retired <= version - retain]:
        remove(spark, f"{store}/parts/{part.name}")
        parts.remove(part)
    rows = [{"last_batch": state.last_batch, **asdict(part)} for part in parts]
    rows = rows or [{"last_batch": state.last_batch, "name": None, "level": None, "files": None, "retired": None}]
    noted = spark.createDataFrame([tuple(row.values()) for row in rows], _MANIFEST_SCHEMA)
    noted.coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest/version={version}")
    if version > retain:
        remove(spark, f"{store}/manifest/version={version - retain}")


def _read(spark: SparkSession, store: str, parts: list[Part], table: str) -> DataFrame:
    return spark.read.parquet(*[f"{store}/parts/{part.name}/{table}" for part in parts])


def _merged(spark: SparkSession, store: str, state: Manifest, parts: list[Part], level: int) -> Manifest:
    """The same state with one part in place of several."""
    name = f"level={level}-batch={state.last_batch}"
    winners = merge_winners(_read(spark, store, parts, "winners"), ORDER)
    winners.write.mode("overwrite").parquet(f"{store}/parts/{name}/winners")
    _read(spark, store, parts, "rejected").write.mode("overwrite").parquet(f"{store}/parts/{name}/rejected")
    old = tuple(replace(p, retired=0) if p in parts else p for p in state.parts)  # 0: by the version that comes next
    return replace(state, parts=(*old, Part(name, level, sum(p.files for p in parts))))


def add_batch(
    documents: DataFrame,
    batch_id: int,
    store: str,
    standardise: bool = False,
    mode: str = "substring",
    merge_every: int = 8,
    retain: int = 10,
) -> None:
    """Fold ``(file, v, problem)`` documents into the store."""
    spark = documents.sparkSession
    state = manifest(spark, store)
    if batch_id <= state.last_batch:
        return
    # Parsed once.
    records, part = f"{store}/records/batch={batch_id}", f"{store}/parts/level=0-batch={batch_id}"
    read = Observation()
    normalise(documents).observe(read, readable_files().alias("files")).write.mode("overwrite").parquet(records)
    rows = spark.read.parquet(records)
    found = standardise_contacts(listings(rows)) if standardise else listings(rows)
    dedupe(found, ORDER, mode).write.mode("overwrite").parquet(f"{part}/winners")
    rejected(rows).write.mode("overwrite").parquet(f"{part}/rejected")
    added = Part(f"level=0-batch={batch_id}", 0, read.get["files"])
    state = replace(state, last_batch=batch_id, parts=(*state.parts, added))
    # A merge that fills the next level is made there at once.
    level, full = 0, []
    while len(state.live(level)) + (level > 0) >= merge_every:
        full += state.live(level)
        level += 1
    if full:
        state = _merged(spark, store, state, full, level)
    _commit(spark, store, state, retain)
    remove(spark, records)


def compact(spark: SparkSession, store: str, retain: int = 10) -> None:
    """Merge all parts into one."""
    state = manifest(spark, store)
    if len(state.live()) > 1:
        level = max(p.level for p in state.live()) + 1
        _commit(spark, store, _merged(spark, store, state, state.live(), level), retain)


def _state(spark: SparkSession, store: str) -> Manifest:
    state = manifest(spark, store)
    if not state.version:
        raise ValueError(f"nothing has been folded into {store} yet")
    return state


def read_directory(spark: SparkSession, store: str) -> DataFrame:
    """The directory over everything folded in so far."""
    parts = _state(spark, store).live()
    winners = _read(spark, store, parts, "winners")
    return merge_winners(winners, ORDER) if len(parts) > 1 else winners


def read_rejected(spark: SparkSession, store: str) -> DataFrame:
    """``(file, pos, problem)`` of all that could not be used so far."""
    return _read(spark, store, _state(spark, store).live(), "rejected")


def publish(spark: SparkSession, store: str, output_path: str, formats: tuple[str, ...] = ("json", "csv")) -> Directory:
    """Roll-up, summary and exports of a store, as a batch run over the same documents gives them.

    The directory is merged once, into a table below ``output_path``, and all else reads that.
    """
    state = _state(spark, store)
    kept = Observation()
    winners = read_directory(spark, store).observe(kept, *duplicate_numbers())
    winners.write.mode("overwrite").parquet(f"{output_path}/directory")
    businesses = spark.read.parquet(f"{output_path}/directory")
    numbers = {"input_files": sum(p.files for p in state.live()), **kept.get}
    return Directory(
        businesses=businesses,
        rejected=_read(spark, store, state.live(), "rejected"),
        by_state=by_state(businesses),
        summary=one_row(spark, numbers),
        output_files=export(businesses, output_path, formats),
    )
