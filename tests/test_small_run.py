"""A small run written by hand: kept replies in, the exact directory out."""

import glob
import json

from pyspark.sql import functions as F

from placebook.plans.directory import directory_of
from placebook.sinks.replies import replayed
from placebook.streaming import replies as stream
from placebook.streaming import store as kept


def _reply(city, state, *businesses):
    fields = ["company_name", "address", "phone", "website", "email"]
    listed = [dict.fromkeys(fields) | b for b in businesses]
    envelope = {"task_id": f"search_{state}_{city}", "city": city, "state": state, "businesses": listed}
    return f"search_{state}_{city}", f"I will look for companies in {city}.\n\nFound these:\n{json.dumps(envelope, indent=2)}"


REPLIES = [
    _reply("Waco", "TX", {"company_name": "Acme LLC", "phone": "555-1"}, {"company_name": "Solo", "address": "1 Main, Rear"}),
    _reply("Austin", "TX", {"company_name": "ACME", "address": "2 Oak", "phone": "555-2", "website": "acme.example"},
           {"company_name": "Solo Inc", "address": "9 Elm"}),
    _reply("Fresno", "CA", {"company_name": "acme corp", "address": "3 Fir", "phone": "555-3", "email": "a@acme.example"},
           {"company_name": ""}, {"company_name": 'The "Best" Co', "email": "b"}),
    _reply("Macon", "GA"),
    ("search_GA_Athens", "I found nothing [yet]."),
]
ORDER = ["search_CA_Fresno", "search_TX_Waco", "search_TX_Austin", "search_GA_Macon"]

# Of listings with equally many fields the first in the given order stays, in the place where its
# business was seen first.
CSV = (
    "company_name,city,state,address,phone,website,email,industry,source_task\r\n"
    "acme corp,,,3 Fir,555-3,,a@acme.example,,search_CA_Fresno.json\r\n"
    '"The ""Best"" Co",,,,,,b,,search_CA_Fresno.json\r\n'
    'Solo,,,"1 Main, Rear",,,,,search_TX_Waco.json\r\n'
)


def _texts(spark):
    return spark.createDataFrame(REPLIES, "task_id string, value string")


def test_the_directory_of_a_run(spark, tmp_path):
    order = spark.createDataFrame([(f"{name}.json", i) for i, name in enumerate(ORDER)], "file string, file_ord int")
    built = directory_of(replayed(_texts(spark)), str(tmp_path), ("csv", "document"), order)
    parts = sorted(glob.glob(f"{tmp_path}/results.csv/part-*"))
    assert "".join(open(part, newline="").read() for part in parts) == CSV
    # An empty list is no payload and is not kept; prose without JSON is none either.
    assert tuple(built.summary.first()) == (3, 6, 3, 3)
    assert [tuple(r) for r in built.by_state.collect()] == [("Unknown", 0, 3)]
    assert [p.rsplit("/", 1)[1] for p in built.output_files] == ["results_document.json", "results.csv"]


def test_envelopes_keep_places_apart(spark, tmp_path):
    built = directory_of(replayed(_texts(spark), "outermost"), str(tmp_path), ())
    assert tuple(built.summary.first()) == (4, 6, 6, 0)
    assert [tuple(r) for r in built.by_state.collect()] == [("CA", 1, 2), ("TX", 2, 4)]


def test_a_long_stream_stays_short(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    rows = spark.range(12).select(
        F.concat(F.lit("f"), "id", F.lit(".json")).alias("file"),
        F.concat(F.lit('{"businesses": [{"company_name": "Firm '), F.col("id") % 5, F.lit('"}, 7]}')).alias("value"),
    )
    rows.repartition(12, "file").write.option("maxRecordsPerFile", 1).parquet(folder)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream.keep_directory(source, store, str(tmp_path / "c"), merge_every=4).awaitTermination()
    live = kept.manifest(spark, store).live()
    assert [p.level for p in live] == [1, 1, 1] and sum(p.files for p in live) == 12
    found = kept.read_directory(spark, store)
    assert sorted((r.company_name, r.sightings) for r in found.collect()) == [
        ("Firm 0", 3), ("Firm 1", 3), ("Firm 2", 2), ("Firm 3", 2), ("Firm 4", 2),
    ]
    assert kept.read_rejected(spark, store).count() == 12
