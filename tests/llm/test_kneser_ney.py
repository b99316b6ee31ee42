import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from placebook.llm.kneser_ney import coded, decoded, discounts, scored, summed
from tests.llm.cases import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(SMALL)), "\n"]


def out_of_training(doc):
    return zlib.crc32(str("" if doc is None else doc).encode()) % 5 == 1


class Model:
    """The same model over dictionaries."""

    def __init__(self, rows):
        train = [tokens(t) for d, t in rows if not out_of_training(d)]
        self.words = Counter(w for t in train for w in t)
        self.n = sum(self.words.values())
        self.pairs = Counter(p for t in train for p in zip(["\r", *t], t, strict=False))
        self.follows = Counter(w for _, w in self.pairs)
        self.context = defaultdict(list)
        for (u, _), c in self.pairs.items():
            self.context[u].append(c)
        self.d2 = discounts([sum(c == k for c in self.pairs.values()) for k in (1, 2, 3, 4)])
        self.d1 = discounts([sum(c == k for c in self.follows.values()) for k in (1, 2, 3, 4)])

        self.left1 = sum(self.d1[min(x, 3) - 1] for x in self.follows.values())
        self.left2 = {u: sum(self.d2[min(x, 3) - 1] for x in own) / sum(own) for u, own in self.context.items()}
        self.total = {u: sum(own) for u, own in self.context.items()}

    def word(self, w):
        size, v = len(self.pairs), len(self.words) + 1
        if not size:
            return 1 / v
        c = self.follows[w]
        left = self.left1 / size
        return max(c - (self.d1[min(c, 3) - 1] if c else 0), 0) / size + left / v

    def pair(self, u, w):
        if u not in self.total:
            return self.word(w)
        c = self.pairs[u, w]
        return max(c - (self.d2[min(c, 3) - 1] if c else 0), 0) / self.total[u] + self.left2[u] * self.word(w)

    def row(self, doc, text):
        t = tokens(text)
        base = sum(math.log10((self.words[w] + 0.5) / (self.n + 0.5 * (len(self.words) + 1))) for w in t)
        score = sum(math.log10(self.pair(u, w)) for u, w in zip(["\r", *t], t, strict=False))
        return doc, out_of_training(doc), len(t), sum(self.words[w] > 0 for w in t), self.n, base, score


def check(out, rows):
    model = Model(rows)
    want = sorted((model.row(*r) for r in rows), key=str)
    got = sorted(map(tuple, out), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    return model


@pytest.mark.parametrize("part_bytes", [1 << 25, 1 << 12])
def test_equals_brute_force(docs, rows, tmp_path, part_bytes):
    check(scored(docs, f"file://{tmp_path}", part_bytes).collect(), rows)


def test_given_documents(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out = scored(frame(spark, rows), str(tmp_path), 1 << 17).collect()
    check(out, rows)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # better than single words


def test_probabilities_sum_to_one(rows):
    model = Model(rows)
    for u in ["\r", "w1", "a", "never seen"]:
        known = [*model.words, "unknown"]
        assert math.isclose(sum(model.pair(u, w) for w in known), 1, rel_tol=1e-9)


def test_copies_null_ids_and_empty_tables(spark, nothing, tmp_path):
    rows = [(None, "a B"), (None, None), (7, "a b"), (7, "a b")]
    check(scored(frame(spark, rows), f"{tmp_path}/a").collect(), rows)
    only = next(i for i in range(99) if out_of_training(i))
    check(scored(frame(spark, [(only, "x y")]), f"{tmp_path}/b").collect(), [(only, "x y")])
    assert scored(nothing, f"{tmp_path}/c").count() == 0


def test_blobs_come_back():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    counts = np.arange(len(keys))
    back, (got,) = decoded(coded(keys, [counts]), 1)
    assert (back == keys).all() and (got == counts).all()


def test_counts_beyond_32_bits_are_refused():
    keys = np.array([3, 9], np.uint64)
    most = (1 << 32) - 1
    assert decoded(coded(keys, [np.array([1, most])]), 1)[1][0].tolist() == [1, most]
    merged, (total,) = summed(np.array([3, 3], np.uint64), [np.array([most, 1])])  # two tasks' blobs
    with pytest.raises(OverflowError):
        coded(merged, [total])
