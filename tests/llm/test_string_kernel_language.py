import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placebook.llm.shared import read
from placebook.llm.string_kernel_language import Kernel, Model, identified, kernel_matrix, predicted, presences, solved, spaced, trained
from tests.llm import cases

SMALL = Kernel(longest=3, bits=20, landmarks=8, sample=64)


def strings(text, longest):
    """All runs of 1 to ``longest`` bytes of the spaced text."""
    data = bytes(spaced(pa.array([text])).data)
    return {data[i : i + k] for k in range(1, longest + 1) for i in range(len(data) - k + 1)}


def has_of(column, kernel):
    return np.concatenate([has for _, has in presences(spaced(pa.array(column, pa.string())), kernel)])


def test_texts_become_words_with_single_spaces():
    given = spaced(pa.array(["Ab, c9d\n", None, "", "12 3", "É!", "z"]))
    parts = [bytes(given.data[a:b]).decode() for a, b in zip(given.bounds[:-1], given.bounds[1:], strict=True)]
    assert parts == [" ab c d ", "", "", "", " é ", " z "]


def test_kernel_is_that_of_the_sets_of_strings():
    column = [t for _, t in cases.documents()][:16]
    sets = [strings(t, SMALL.longest) for t in column]
    has = has_of(column, SMALL)
    want = [[len(a & b) / max(1, len(a) * len(b)) ** 0.5 for b in sets] for a in sets]
    assert np.allclose(kernel_matrix(has, has.astype(np.float32)), want, atol=2e-3)  # a few strings share a place of 2**20


def test_pieces_of_a_long_text_change_nothing(monkeypatch):
    column = ["the cat sat on the mat " * 40, None, "q", "une souris verte " * 9]
    whole = has_of(column, SMALL)
    monkeypatch.setattr("placebook.llm.string_kernel_language.PIECE", 7)
    assert (has_of(column, SMALL) == whole).all()


def test_landmarks_that_are_the_whole_sample_give_exact_ridge_regression():
    rng = random.Random(5)
    column = ["".join(rng.choice("abcdefg" if i % 2 else "fghijkl") for _ in range(60)) for i in range(20)]
    has, target = has_of(column, SMALL), np.arange(20) % 2
    kernel = Kernel(longest=3, bits=20, landmarks=20, sample=20, ridge=1e-3)
    model = solved(kernel, ["x", "y"], target, np.packbits(has, axis=1))
    full = kernel_matrix(has, has.astype(np.float32)).astype(float)
    middle = full - full.mean(0) - full.mean(1)[:, None] + full.mean()  # centred in the kernel's own space
    wanted = np.eye(2)[target]
    ridge = middle @ np.linalg.solve(middle + kernel.ridge * 20 * np.eye(20), wanted - wanted.mean(0)) + wanted.mean(0)
    order = np.concatenate([np.flatnonzero(target == k) for k in (0, 1)])
    got = full[:, order] @ model.weights + model.offsets
    assert np.allclose(got, ridge, atol=1e-3)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_accuracy(spark, sf):
    docs = read(spark, f"/root/testdata/{sf}", "documents")
    told = identified(docs).join(docs.select("doc_id", "lang", "text"), "doc_id")
    held = told.where(F.col("held_out") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).collect()
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in held)
    assert told.where(~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & ((F.col("lang_pred") != "und") | (F.col("score") != 0))).count() == 0


def test_held_out_rows_and_other_columns_are_not_learned_from(spark):
    rng = random.Random(1)

    def row(i, wrong=False):
        lang = "xy"[i % 2]
        text = " ".join("".join(rng.choice("abcde" if lang == "x" else "vwxyz") for _ in range(6)) for _ in range(30))
        return (i, text, "junk" if wrong else lang, "src", [1])

    docs = spark.createDataFrame([row(i) for i in range(200)], "doc_id long, text string, lang string, source string, label array<int>")
    from placebook.llm.string_kernel_language import held_out

    own = {r.doc_id for r in docs.where(held_out(F.col("doc_id"))).collect()}
    assert 20 < len(own) < 80
    spoilt = docs.withColumn("lang", F.when(F.col("doc_id").isin(*own), "junk").otherwise(F.col("lang")))
    got = identified(spoilt).collect()
    assert {r.lang_pred for r in got} == {"x", "y"}
    assert all(r.lang_pred == "xy"[r.doc_id % 2] and r.held_out == (r.doc_id in own) for r in got)


def test_awkward_rows_and_empty_tables(spark, rows):
    with_lang = [(i, t, [None, "a", "b"][k % 3], 1, 2, 3) for k, (i, t) in enumerate([*rows, (None, "abc"), (None, None), *[rows[4]] * 50])]
    docs = spark.createDataFrame(with_lang, "doc_id long, text string, lang string, label int, spread int, bits int")
    got = identified(docs).collect()
    assert len(got) == len(with_lang)
    assert all((r.lang_pred == "und") == (r.score == 0.0) or r.lang_pred in "ab" for r in got)
    unknown = identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)} and len(unknown) == len(with_lang)
    assert identified(docs.limit(0)).collect() == []
    assert sorted(map(str, got)) == sorted(map(str, identified(docs.repartition(7)).collect()))


def test_copies_do_not_fill_the_sample(spark):
    rows = [(i, "abc abd " * 5, "x") for i in range(300)] + [(300 + i, f"abe{chr(97 + i % 26)}{chr(97 + i // 26)}", "x") for i in range(60)]
    rows += [(1000 + i, f"vw{chr(97 + i % 26)}{chr(97 + i // 26)} zz", "y") for i in range(60)]
    model = trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"), Kernel(sample=40, landmarks=20))
    assert isinstance(model, Model) and len({m.tobytes() for m in model.marks}) == 20


def test_a_very_long_text(spark):
    docs = spark.createDataFrame(
        [(0, "abcab " * 900_000, "x"), (1, "vwxyz " * 40, "y"), (2, "abc bca", "x"), (5, "zyx wv", "y"), (9, "cab vvv", None)],
        "doc_id long, text string, lang string",
    )
    model = trained(docs)
    got = {r.doc_id: r.lang_pred for r in predicted(docs.withColumn("held_out", F.lit(False)), model).collect()}
    assert got[0] == "x" and got[1] == "y"
