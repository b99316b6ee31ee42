import os
import pathlib
import re
import sysconfig

from placebook.llm.compression_bands import Bands, fitted, judged
from tests.llm.cases import collected, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_equal_brute_force(docs, rows):
    assert collected(judged(docs), *COLUMNS) == sorted((i, *expected(t)) for i, t in rows)


def test_whole_small_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = [(r.doc_id, r.text) for r in table.collect() if len(r.text) < 6000]
    assert collected(judged(frame(spark, short)), *COLUMNS) == sorted((i, *expected(t)) for i, t in short)


def test_verdict_of_the_method(spark):
    noise = os.urandom(6000).hex()
    clean = " ".join(f"{i * i % 7919:x}word{i * 31 % 677}" for i in range(400))
    texts = [
        " ".join(noise[i : i + 9] for i in range(0, 6000, 9)),  # hexadecimal digits still halve
        clean,
        " ".join(chr(0x4E00 + b) for b in os.urandom(5000)),
        "".join(f"{i % 10 ** 3:03d}{'=' * 60} " for i in range(900)),
    ]
    got = {r.doc_id: r for r in judged(frame(spark, list(enumerate(texts)))).collect()}
    assert got[1].kept and not got[1].base_failed
    assert got[3].ratio > 6 and not got[3].kept
    strict = Bands(limits=((0, 3.0, 4.0),))
    assert not any(r.kept for r in judged(frame(spark, [(0, texts[0])]), strict).collect())


def test_a_bad_chunk_share_rejects(spark):
    good = " ".join(f"w{i * 7919 % 100003}" for i in range(900))
    bad = "".join(f"{i:04d}{'-' * 70} " for i in range(700))
    got = judged(frame(spark, [(0, good + " " + bad)]), Bands(limits=((0, 0.0, 6.0),), bad_share=0.5)).first()
    assert got.n_chunks > 3 and got.n_bad_chunks > got.n_chunks / 2 and not got.kept


def test_empty_table(nothing):
    assert judged(nothing).count() == 0


def labelled(spark, size):
    folder = f"/root/testdata/{size}"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return docs, spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")


def test_bands_fitted_to_labels_catch_junk_and_leave_clean_texts(spark):
    """Fitted to one table, held against the labels of another."""
    bands = fitted(*labelled(spark, "sf0.1"))
    docs, labels = labelled(spark, "sf0.01")
    sized = docs.selectExpr("doc_id", "octet_length(text) AS size")
    got = judged(docs, bands).join(labels, "doc_id").join(sized, "doc_id").where("not base_failed").collect()
    clean, junk = ([r for r in got if r.quality == q] for q in (1, 0))
    assert clean and all(r.kept for r in clean)
    long = [r for r in junk if r.size >= 5120]
    assert long and not any(r.kept for r in long)


def test_without_labels_the_limits_are_wide(spark):
    docs, labels = labelled(spark, "sf0.001")
    assert fitted(docs, labels.limit(0)) == Bands()
    assert fitted(docs.limit(0), labels) == Bands()
    assert fitted(docs, labels.where("quality = 0")) == Bands()
    few = fitted(docs, labels, sample=9)
    assert few.limits == Bands().limits


def test_the_sample_is_bounded_and_takes_odd_labels(spark):
    docs, labels = labelled(spark, "sf0.01")
    odd = labels.unionAll(labels).unionAll(spark.createDataFrame([(None, 1), (-5, 1), (3, None)], "doc_id long, quality int"))
    assert fitted(docs, odd) == fitted(docs, labels)
    narrow = fitted(docs, labels)
    assert sum(a != b for a, b in zip(narrow.limits, Bands().limits, strict=True)) >= 5


def ordinary():
    """Texts nobody made for this: prose, source code, and tables as they are printed."""
    library = pathlib.Path(sysconfig.get_paths()["stdlib"])
    packages = pathlib.Path(sysconfig.get_paths()["purelib"])
    prose = [*packages.glob("*/LICENSE*"), *packages.glob("*/licenses/*"), *packages.glob("*/METADATA"), *pathlib.Path("/usr/share/common-licenses").glob("*")]
    kinds = {"prose": prose, "source": [*library.glob("*.py"), *library.glob("*/*.py")]}
    for kind, files in kinds.items():
        yield kind, [f.read_text(errors="replace") for f in sorted(files) if f.is_file()][:600]
    import pyarrow.parquet as pq

    tables = []
    for name in ("customer", "part", "orders", "lineitem", "supplier"):
        rows = pq.read_table(f"/root/testdata/sf0.01/{name}.parquet").slice(0, 2000).to_pylist()
        for size in (15, 60, 300):
            tables += ["\n".join(" | ".join(map(str, r.values())) for r in rows[at : at + size]) for at in range(0, min(len(rows), 1000), size)]
    yield "table", tables


def test_ordinary_texts_pass(spark):
    for kind, found in ordinary():
        got = judged(frame(spark, list(enumerate(found)))).where("not base_failed").collect()
        assert len(got) >= 20, kind
        assert sum(r.kept for r in got) >= 0.95 * len(got), kind


def test_limits_come_from_every_labelled_text(spark):
    """The texts behind the first 10,000 ids by hash, which a bounded sample left out, are others."""
    ids = spark.range(10_300).selectExpr("id AS doc_id", "row_number() OVER (ORDER BY xxhash64(id), id) AS place")
    word = "concat(IF(place > 10000, 'aaa', ''), substr(sha1(concat(doc_id, '-', n)), 1, IF(place > 10000, 2, 5)))"
    docs = ids.selectExpr("doc_id", f"array_join(transform(sequence(1, 60), n -> {word}), ' ') AS text").localCheckpoint()
    labels = docs.selectExpr("doc_id", "1 AS quality")
    whole = fitted(docs, labels)
    assert whole == fitted(docs, labels, sample=10_300)
    assert whole != fitted(docs, labels, sample=10_000)
