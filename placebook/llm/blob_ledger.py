"""Secret scans with a ledger of what was scanned.

Texts are addressed by their SHA-256. The ledger remembers every (blob, rule, rule version) that was
scanned and the findings; a run scans only pairs it has not seen, each blob once however many
documents or versions hold it, and joins findings back to all of them. A rule with a new version
is a new pair.

Matches are leftmost and do not overlap within a rule; those that are too short are dropped after
matching. Null texts are empty and hold nothing. A text of any length is scanned whole, as one row. Repeated rows get equal results. Only doc_id and
text are read; an empty table gives an empty result and leaves the ledger as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placebook.llm.shared import free_name, kept


@dataclass(frozen=True)
class Rule:
    """``group`` of ``pattern`` has to have ``least`` characters; ``hint`` fits wherever a match can be."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str


# The rules of the contract, in listed order. A run of one kind of characters is matched
# whole, so asking for its least length in the pattern drops what would be dropped after matching;
# short runs, which every text is full of, then give no rows.
KEYWORDS = "password|passwd|secret|token|api_?key"
RULES = (
    Rule("assign", 1, rf"""((?i:{KEYWORDS}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, f"(?i:{KEYWORDS})"),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}", 0, 18, "AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, "[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),
)

SCANNED = "blob binary, kind string, version int"
FINDINGS = "blob binary, kind string, version int, start long, end long"


class Ledger:
    """Two growing tables in a folder: pairs scanned, and findings."""

    def __init__(self, folder: str) -> None:
        self.scanned, self.findings = f"{folder}/scanned", f"{folder}/findings"

    def read(self, docs: DataFrame, path: str, schema: str) -> DataFrame:
        return docs.sparkSession.read.schema(schema).parquet(path)

    def begin(self, docs: DataFrame) -> None:
        """Append nothing to both tables, so that they can be read before the first scan."""
        for path, schema in ((self.scanned, SCANNED), (self.findings, FINDINGS)):
            fields = [field.split() for field in schema.split(", ")]
            none = docs.sparkSession.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in fields])
            none.write.mode("append").parquet(path)


def blobs_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "blob", F.unhex(F.sha2("text", 256))
    )


def matches(scans: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings in ``scans`` (blob, kinds, text): (blob, kind, version, start, end) in code points."""
    tried = [
        F.when(
            F.array_contains("kinds", rule.kind) & F.col("text").rlike(rule.hint),
            F.struct(
                F.lit(rule.kind).alias("kind"),
                F.lit(rule.version).alias("version"),
                F.lit(rule.least).alias("least"),
                F.arrays_zip(
                    F.split("text", rule.pattern, -1).alias("before"),
                    F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("whole"),
                    F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)).alias("value"),
                ).alias("found"),
            ),
        )
        for rule in rules
    ]
    # A document row that is there twice is scanned twice; "copy" keeps the two apart.
    each = scans.withColumn("copy", F.monotonically_increasing_id()).select(
        "blob", "copy", F.explode(F.array_compact(F.array(*tried))).alias("t")
    )
    rows = each.select("blob", "copy", "t.kind", "t.version", "t.least", F.posexplode("t.found").alias("i", "f")).select(
        "blob",
        "copy",
        "kind",
        "version",
        "i",
        F.char_length("f.before").cast("long").alias("gap"),
        F.char_length("f.whole").cast("long").alias("size"),
        (F.char_length("f.value") >= F.col("least")).alias("long_enough"),
    )
    # What stands before a match: all gaps up to it and all earlier matches.
    upto = Window.partitionBy("blob", "copy", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    return (
        rows.where(F.col("size").isNotNull())
        .withColumn("end", end)
        .where("long_enough")
        .select("blob", "kind", "version", (F.col("end") - F.col("size")).alias("start"), "end")
    )


def scan(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger in ``folder`` up to date with ``docs``; return the findings of its blobs."""
    ledger = Ledger(folder)
    ledger.begin(docs)
    blobs = blobs_of(docs)
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    seen = ledger.read(docs, ledger.scanned, SCANNED)
    unseen = (
        blobs.groupBy("blob")
        .agg(F.min("doc_id").alias("rep_id"))
        .select("blob", "rep_id", F.explode(wanted).alias("w"))
        .select("blob", "rep_id", "w.kind", "w.version")
        .join(seen, ["blob", "kind", "version"], "left_anti")
    )
    todo = kept(unseen, f"{folder}/todo-{uuid.uuid4().hex}")
    per_blob = todo.groupBy(F.col("blob").alias("todo_blob"), "rep_id").agg(F.collect_set("kind").alias("kinds"))
    scans = (
        blobs.join(per_blob, (F.col("blob") == F.col("todo_blob")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
        .select("blob", "kinds", "text")
    )
    matches(scans, rules).distinct().write.mode("append").parquet(ledger.findings)
    # Last, so that a pair counts as scanned only once its findings are stored.
    todo.select("blob", "kind", "version").write.mode("append").parquet(ledger.scanned)
    current = F.lit(False)
    for rule in rules:
        current = current | ((F.col("kind") == rule.kind) & (F.col("version") == rule.version))
    return ledger.read(docs, ledger.findings, FINDINGS).where(current).distinct()


def secrets(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and spans of the secrets of every row of ``docs``."""
    findings = scan(docs, folder, rules)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    entry = F.struct("start", order[F.col("kind")].alias("rank"), "end", "kind")
    by_blob = findings.groupBy("blob").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    text = F.concat_ws(
        ",", F.transform("found", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))
    )

    def count(kind: str):
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long")

    counts = {f"n_{r.kind}": count(r.kind) for r in rules}
    # Stored, as Spark splits the rows of a blob with many copies only if both sides are shuffled anew.
    told = by_blob.select("blob", text.alias("spans"), *[c.alias(name) for name, c in counts.items()])
    told = kept(told, f"{folder}/told-{uuid.uuid4().hex}")
    spans = F.coalesce("spans", F.lit(""))
    return (
        blobs_of(docs)
        .select("doc_id", "blob")
        .join(told, "blob", "left")
        .select(
            "doc_id",
            *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in counts],
            F.sha2(spans, 256).alias("base_sha256"),
            spans.alias("spans"),
            F.lower(F.hex("blob")).alias("blob"),
        )
    )


MASK = "[secret]"


def masked(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with all their columns; spans of secrets, joined where they overlap, read ``[secret]``."""
    findings = scan(docs, folder, rules)
    told_blob, told_spans = free_name(docs, "told_blob"), free_name(docs, "told_spans")
    # A span begins a new stretch if all before it in its text end earlier.
    earlier = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("blob").orderBy("start", "end")
    stretches = (
        findings.select("blob", "start", "end")
        .distinct()
        .withColumn("new", F.coalesce(F.col("start") > F.max("end").over(earlier), F.lit(True)).cast("int"))
        .withColumn("stretch", F.sum("new").over(upto))
        .groupBy("blob", "stretch")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy(F.col("blob").alias(told_blob))
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(told_spans))
    )
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def stretch(at, to):
        return F.substring("text", (at + 1).cast("int"), (to - at).cast("int"))

    # Text between secrets: from the end of one to the start of the next.
    starts = F.concat(F.transform(told_spans, lambda s: s["start"]), F.array(F.char_length("text").cast("long")))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(told_spans, lambda s: s["end"]))
    between = F.zip_with(ends, starts, stretch)
    text = F.when(F.col(told_spans).isNull(), F.col("text")).otherwise(F.array_join(between, MASK))
    joined = docs.join(stretches, F.unhex(F.sha2(whole, 256)) == F.col(told_blob), "left")
    changed = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn(
            "n_chars", F.when(F.col(told_spans).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
        )
    return changed.drop(told_blob, told_spans)
