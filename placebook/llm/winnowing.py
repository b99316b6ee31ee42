"""Benchmark decontamination by winnowing.

Words are runs of ASCII digits and letters (A-Z made small) and of all non-ASCII characters. Of the
hashes of all grams of ``gram`` words, the least of every ``window`` consecutive ones is kept. A
passage of ``gram + window - 1`` words that stands in two texts has the same least hash in both,
so every shared passage of that length shows as an equal fingerprint. Documents that share a
fingerprint with a benchmark item are looked at again: each hit is extended to all passages that
hold it, and these are compared word by word with those of the items.

A benchmark item of fewer words than a passage is one passage by itself; documents are searched
for all grams of such lengths. Null and empty texts have no words and hit nothing. Equal items
count as often as they occur if their ids differ. Repeated document rows get one result each. Only
doc_id, text and item_id are read. A text is taken whole, as one row: a very long one takes memory in
proportion to its words in the task that holds it. With no documents the result is empty, with no items nothing
is hit.

Everything is built from array functions. Each step that reads an array twice is a column of its
own, because Spark would else copy the expression into every use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebook.llm.shared import kept, matched

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PASSAGE, GRAM = 13, 6
#: Benchmark rows that may be broadcast; beyond this the join is shuffled.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() changes other capitals too; of ASCII texts it is right, and faster.
    ascii_only = F.octet_length(text) == F.char_length(text)
    small = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))
    return F.array_remove(F.split(small, SEPARATORS, -1), "")


def _shifted(df: DataFrame, left: str, right: str, by: int, how, name: str) -> DataFrame:
    """``name[i] = how(left[i], right[i + by])``; what reaches beyond the end is null or partial."""
    tail = F.slice(right, F.lit(by + 1), F.greatest(F.size(right), F.lit(1)))
    return df.withColumn(name, F.zip_with(left, tail, how))


def with_grams(df: DataFrame, length: int) -> DataFrame:
    """Add ``g<length>``: for each position the hash of the ``length`` words from there.

    Longer hashes come from shorter ones by doubling. Entries less than ``length`` words before
    the end are to be ignored.
    """
    if "g1" not in df.columns:
        df = df.withColumn("g1", F.transform("words", lambda w: F.xxhash64(w)))
    if f"g{length}" in df.columns:
        return df
    half = 1 << (length.bit_length() - 1)
    if half == length:
        half //= 2
    df = with_grams(with_grams(df, half), length - half)
    return _shifted(df, f"g{half}", f"g{length - half}", half, lambda a, b: F.xxhash64(a, b), f"g{length}")


def with_prints(df: DataFrame, length: int, gram: int) -> DataFrame:
    """Add ``prints``: for each passage of ``length`` words the least hash of its grams."""
    df = with_grams(df, gram)
    full = F.slice(f"g{gram}", F.lit(1), F.greatest(F.size("words") - (gram - 1), F.lit(0)))
    df = df.withColumn("m1", full)
    window, have = length - gram + 1, 1
    while have < window:
        step = min(have, window - have)
        df = _shifted(df, f"m{have}", f"m{have}", step, lambda a, b: F.least(a, b), f"m{have + step}")
        have += step
    return df.withColumn("prints", F.slice(f"m{have}", F.lit(1), F.greatest(F.size("words") - (length - 1), F.lit(0))))


def _worded(table: DataFrame, *keys: Column) -> DataFrame:
    return table.select(*keys, words_of(F.col("text")).alias("words"))


def _doc_keys() -> tuple[Column, Column]:
    return F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key")


def _small_enough(df: DataFrame) -> DataFrame:
    """Marked for broadcast only if it was counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _hits(docs: DataFrame, items: DataFrame, length: int, gram: int) -> DataFrame:
    """Passages of documents that equal a passage of an item: (doc_id, text_key, first, length, items)."""
    if length == PASSAGE:
        items = items.where(F.size("words") >= length)
    else:
        items = items.where(F.size("words") == length)
    found = with_grams(with_prints(items, length, gram), length)
    passages = (
        found.select("item_id", "words", F.posexplode(F.arrays_zip("prints", F.slice(f"g{length}", F.lit(1), F.size("prints")).alias("whole"))).alias("at", "p"))
        .select("item_id", "p.prints", "p.whole", F.slice("words", F.col("at") + 1, F.lit(length)).alias("passage"))
        .groupBy("whole", "passage", "prints")
        .agg(F.collect_set("item_id").alias("items"))
    )
    prints = passages.select("prints").distinct()
    marked = (
        with_prints(_worded(docs, *_doc_keys()), length, gram)
        .select("doc_id", "text_key", F.explode(F.array_distinct("prints")).alias("prints"))
        .join(_small_enough(prints), "prints", "left_semi")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("prints").alias("shared"))
        .select(F.col("doc_id").alias("marked_id"), F.col("text_key").alias("marked_key"), "shared")
    )
    # Only the marked documents are split into words again, after the join.
    again = docs.select(*_doc_keys(), "text").join(
        marked, F.col("doc_id").eqNullSafe(F.col("marked_id")) & F.col("text_key").eqNullSafe(F.col("marked_key"))
    )
    again = _worded(again, F.col("doc_id"), F.col("text_key"), F.col("shared"))
    again = with_grams(with_prints(again, length, gram), length)
    at = F.array_compact(F.transform("prints", lambda x, i: F.when(F.array_contains("shared", x), i)))
    return (
        again.select("doc_id", "text_key", "words", f"g{length}", F.explode(F.array_distinct(at)).alias("first"))
        .select(
            "doc_id",
            "text_key",
            F.col("first").cast("long").alias("first"),
            F.lit(length).cast("long").alias("length"),
            F.get(f"g{length}", F.col("first")).alias("whole"),
            F.slice("words", F.col("first") + 1, F.lit(length)).alias("passage"),
        )
        .join(_small_enough(passages.select("whole", "passage", "items")), ["whole", "passage"])
        .select("doc_id", "text_key", "first", "length", "items")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM) -> DataFrame:
    """For each row of ``docs``: its words, the words hit, and the benchmark items found in it."""
    items = _worded(benchmark, F.col("item_id").cast("string").alias("item_id")).where(F.size("words") > 0)
    # At most PASSAGE numbers, however large the benchmark.
    lengths = sorted(row.n for row in items.select(F.least(F.size("words"), F.lit(PASSAGE)).alias("n")).distinct().collect())
    counted = _worded(docs, *_doc_keys()).select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"))
    hits = None
    for length in lengths:
        more = _hits(docs, items, length, min(gram, length))
        hits = more if hits is None else hits.unionByName(more)
    if hits is None:
        found = counted.select("doc_id", "text_key").limit(0).withColumns(
            {"n_hit": F.lit(0).cast("long"), "found_items": F.array().cast("array<string>")}
        )
    else:
        spans = F.array_sort(F.collect_set(F.struct("first", (F.col("first") + F.col("length")).alias("last"))))
        covered = F.aggregate(
            "spans",
            F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
            lambda a, s: F.struct(
                F.greatest(a["to"], s["last"]).alias("to"),
                (a["n"] + F.greatest(s["last"] - F.greatest(a["to"], s["first"]), F.lit(0).cast("long"))).alias("n"),
            ),
        )["n"]
        found = (
            hits.groupBy("doc_id", "text_key")
            .agg(spans.alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("found_items"))
            .select("doc_id", "text_key", covered.alias("n_hit"), "found_items")
        )
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "n_hit", "found_items")
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & F.col("text_key").eqNullSafe(F.col("found_key"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    item_ids = F.array_sort(F.coalesce("found_items", F.array().cast("array<string>")))
    return counted.join(found, same, "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(item_ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", item_ids), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "text_key",
    )


def clean(docs: DataFrame, benchmark: DataFrame, folder: str, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    verdicts = decontaminated(docs, benchmark, gram).where("contaminated").select("doc_id", "text_key").distinct()
    return matched(docs, kept(verdicts, f"{folder}/contaminated"), "left_anti")
