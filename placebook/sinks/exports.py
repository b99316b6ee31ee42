"""Exports of a finished directory.

Every export writes many part files in output order; joining them by name gives the one file.
Nothing is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placebook.fixed_values import CSV_COLUMNS
from placebook.functions.templates import json_text
from placebook.operators.dedupe import FIRST_SEEN
from placebook.operators.normalise import EXTRA_FIELDS
from placebook.session import remove, replace_folder


#: Text formats and the folders they are written to.
FORMATS = {"json": "results.json", "document": "results_document.json", "csv": "results.csv"}


def _places(directory: DataFrame) -> DataFrame:
    """One row: the last place, by which the record without a comma behind it is known."""
    return directory.agg(F.max(FIRST_SEEN).alias("last_place"))


def _frame(rows: DataFrame, directory: DataFrame, lines: list[tuple[int, Column]]) -> DataFrame:
    """Lines in front of (section 0) and behind (section 2) all records."""
    no_place = F.lit(None).cast(directory.schema[FIRST_SEEN].dataType).alias("place")
    return rows.select(
        F.inline(F.array(*[F.struct(F.lit(section).alias("section"), no_place, line.alias("line")) for section, line in lines]))
    )


def _record_json(directory: DataFrame) -> Column:
    """One record as JSON: the nine fields with nulls, then nested attributes if it has any."""
    keep_nulls = {"ignoreNullFields": "false"}
    base = F.to_json(F.struct(*CSV_COLUMNS), keep_nulls)
    if "extra" not in directory.columns:
        return base
    nested = F.to_json(F.struct(*[F.col("extra")[name].alias(name) for name in EXTRA_FIELDS]), keep_nulls)
    both = F.concat(
        F.substring(base, F.lit(1), F.length(base) - 1),
        F.lit(","),
        F.substring(nested, F.lit(2), F.length(nested)),
    )
    return F.when(F.col("extra").isNull(), base).otherwise(both)


def _csv_lines(directory: DataFrame) -> DataFrame:
    """CSV with a header, nine columns, doubled quotes, CRLF line ends and blanks for null.

    Spark's own CSV writer would change line feeds inside values to its line end, and repeat
    the header in every part.
    """
    fields = []
    for name in CSV_COLUMNS:
        doubled = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
        quoted = F.when(F.col(name).rlike('[",\r\n]'), doubled).otherwise(F.col(name))
        fields.append(F.coalesce(quoted, F.lit("")))
    # The writer ends each line with a line feed.
    line = F.concat(F.concat_ws(",", *fields), F.lit("\r"))
    records = directory.select(F.lit(1).alias("section"), F.col(FIRST_SEEN).alias("place"), line.alias("line"))
    header = F.lit(",".join(CSV_COLUMNS) + "\r")
    return _frame(directory.sparkSession.range(1), directory, [(0, header)]).unionByName(records)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """An exported CSV; blanks come back as null, line ends inside values as line feeds."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in CSV_COLUMNS])
    rows = spark.read.options(
        escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).schema(schema).csv(path)
    is_header = F.concat_ws(",", *CSV_COLUMNS) == ",".join(CSV_COLUMNS)
    return rows.where(~is_header)


def _manifest(directory: DataFrame) -> DataFrame:
    return directory.agg(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("generated_at"),
        F.count("*").alias("total_records"),
    )


def _json_lines(directory: DataFrame) -> DataFrame:
    """One JSON object per line."""
    return directory.select(F.lit(1).alias("section"), F.col(FIRST_SEEN).alias("place"), _record_json(directory).alias("line"))


def _document_lines(directory: DataFrame) -> DataFrame:
    """One JSON document over several text parts: envelope, then records, indented by two.

    Its lines are sorted by section and place, so each part holds a stretch of the document.
    """
    fields = []
    for name in CSV_COLUMNS:
        text = json_text(F.col(name), T.StringType())
        fields.append(F.concat(F.lit(f'      "{name}": '), text))
    record = F.concat_ws(",\n", *fields)
    if "extra" in directory.columns:
        nested = [
            F.concat(
                F.lit(f'      "{name}": '),
                json_text(F.col("extra")[name], T.VariantType()),
            )
            for name in EXTRA_FIELDS
        ]
        tail = F.when(F.col("extra").isNotNull(), F.concat(F.lit(",\n"), F.concat_ws(",\n", *nested)))
        record = F.concat(record, F.coalesce(tail, F.lit("")))
    # Every record but the last one has a comma behind it.
    comma = F.when(F.col("last_place").isNull(), ",").otherwise("")
    records = directory.join(
        F.broadcast(_places(directory)), F.col(FIRST_SEEN) == F.col("last_place"), "left"
    ).select(
        F.lit(1).alias("section"),
        F.col(FIRST_SEEN).alias("place"),
        F.concat(F.lit("    {\n"), record, F.lit("\n    }"), comma).alias("line"),
    )
    opening = F.concat(
        F.lit('{\n  "generated_at": "'), "generated_at", F.lit('",\n  "total_records": '),
        F.col("total_records").cast("string"), F.lit(',\n  "businesses": ['),
        F.when(F.col("total_records") == 0, "]\n}").otherwise(""),
    )
    closing = F.when(F.col("total_records") > 0, "  ]\n}")
    frame = _frame(_manifest(directory), directory, [(0, opening), (2, closing)])
    return frame.where("line IS NOT NULL").unionByName(records)


_LINES = {"csv": _csv_lines, "json": _json_lines, "document": _document_lines}


def _write(directory: DataFrame, paths: dict[str, str]) -> None:
    """Write formats in order, each to its path, by one sort of all their lines.

    Lines are dealt out by ranges of format, section and place, so a part file holds a stretch of one
    format and parts sort by name. Nothing is kept on executors: what a lost one had is sorted again,
    and no more.
    """
    spark = directory.sparkSession
    top = paths[next(iter(paths))]
    work = f"{top}-lines"
    lines = None
    for name in paths:
        own = _LINES[name](directory).withColumn("format", F.lit(name))
        lines = own if lines is None else lines.unionByName(own)
    in_order = lines.orderBy("format", "section", "place").select("format", "line")
    in_order.write.mode("overwrite").partitionBy("format").text(work)
    for name, path in paths.items():
        replace_folder(spark, f"{work}/format={name}", path)
    remove(spark, work)


def export_csv(directory: DataFrame, path: str) -> None:
    _write(directory, {"csv": path})


def export_json(directory: DataFrame, path: str) -> None:
    """One JSON object per line in ``businesses``, and ``manifest`` with time and count."""
    _write(directory, {"json": f"{path}/businesses"})
    _manifest(directory).write.mode("overwrite").json(f"{path}/manifest")


def export_json_document(directory: DataFrame, path: str) -> None:
    _write(directory, {"document": path})


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(businesses, manifest)`` of an ``export_json`` folder."""
    fields = ", ".join(f"{name} string" for name in CSV_COLUMNS)
    nested = ", ".join(f"{name} variant" for name in EXTRA_FIELDS)
    businesses = spark.read.schema(f"{fields}, {nested}").json(f"{path}/businesses")
    manifest = spark.read.schema("generated_at string, total_records bigint").json(
        f"{path}/manifest"
    )
    return businesses, manifest


def export(directory: DataFrame, path: str, formats: tuple[str, ...] = ("json", "csv")) -> list[str]:
    """Write the wanted formats by one sort and return the written paths.

    ``json`` is one object per line with a manifest, ``document`` one JSON document with its envelope.
    """
    unknown = set(formats) - set(FORMATS)
    if unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    written = {name: f"{path}/{folder}" for name, folder in FORMATS.items() if name in formats}
    if written:
        _write(directory, {name: f"{to}/businesses" if name == "json" else to for name, to in written.items()})
    if "json" in formats:
        _manifest(directory).write.mode("overwrite").json(f"{written['json']}/manifest")
    return list(written.values())
