import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from placebook.llm.forest_join import Forest, joined
from tests.llm.cases import collected, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("doc_id", "class_id", "n_links", "n_text_links")


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(rows, threshold=Fraction(4, 5)):
    sets = [(doc, shingles(t), " ".join(WORD.findall(t or ""))) for doc, t in rows]
    group = list(range(len(sets)))
    links, different = Counter(), [set() for _ in sets]
    for i, (_, a, x) in enumerate(sets):
        for j, (_, b, y) in enumerate(sets[:i]):
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                if x != y:
                    different[i].add(y)
                    different[j].add(x)
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc, _, _), g in zip(sets, group, strict=True):
        least[g] = min(doc, least.get(g, doc))
    return sorted((doc, least[group[i]], links[i], len(different[i])) for i, (doc, _, _) in enumerate(sets))


def near_copies(seed, groups=12, copies=9):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 12, 60, 150]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9])):
                text[rng.randrange(len(text))] = f"e{rng.randrange(50)}"
            rows.append((len(rows) * 3, " ".join(text)))
    rng.shuffle(rows)
    return rows


def test_awkward_documents(docs, rows, tmp_path):
    assert collected(joined(docs, str(tmp_path)), *COLUMNS) == expected(rows)


@pytest.mark.parametrize("blocks", [(256, 1024), (3, 4)])
def test_near_copies_in_large_and_small_blocks(spark, tmp_path, blocks):
    rows = near_copies(blocks[0])
    forest = Forest(prefix_block=blocks[0], verify_block=blocks[1], verify_bytes=blocks[1] * 1000)
    got = collected(joined(frame(spark, rows), str(tmp_path), forest), *COLUMNS)
    assert got == expected(rows)
    assert max(r[3] for r in got) > 3


def test_whole_small_table(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = collected(joined(frame(spark, rows), str(tmp_path)), *COLUMNS)
    assert got == expected(rows)


def test_prefixes_are_shortened_until_the_recall_is_met():
    assert Forest(recall=0.9).depth() == 4 == Forest().depth()
    assert Forest(trees=8, recall=0.99).depth() == 3
    with pytest.raises(ValueError):
        Forest(trees=1).depth()


def test_repeated_rows_null_ids_and_an_empty_table(spark, nothing, tmp_path):
    text = "a b c d e f g"
    docs = frame(spark, [(3, text), (3, text), (3, "x"), (None, "y z"), (None, None), (8, text)])
    out = sorted(((r.doc_id or 0, r.class_id or 0, r.n_links) for r in joined(docs, f"{tmp_path}/a").collect()))
    assert out == [(0, 0, 0), (0, 0, 0), (3, 3, 0), (3, 3, 2), (3, 3, 2), (8, 3, 2)]
    assert joined(nothing, f"{tmp_path}/b").count() == 0
