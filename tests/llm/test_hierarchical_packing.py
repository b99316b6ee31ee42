import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from placebook.llm.hierarchical_packing import Packing, packed, packed_pieces, steps_of
from tests.llm.cases import frame

FILE = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(FILE)


def check(out, rows):
    """Each id lies in exactly one piece; sequences have no gap; returns sizes of the sequences."""
    ids = {i: [*WHOLE.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        data = np.array(own[r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(data) and len(data) == 4 * r.length > 0
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.window))
    assert set(pieces) == set(ids)
    for spans, size in [(p, len(ids[d])) for d, p in pieces.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length, *_ in sorted(spans):
            assert start == at
            at += length
        assert size is None or at == size
    return [(sum(x[1] for x in s), s[0][2]) for s in sequences.values()]


def test_awkward_documents(docs, rows):
    sizes = check(packed_pieces(docs, FILE, 2).collect(), rows)
    assert sum(size != window for size, window in sizes) <= 1


def test_groups_and_padding(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sizes = check(packed_pieces(frame(spark, rows), FILE, 2, group_bytes=1 << 20).collect(), rows)
    assert sum(size != window for size, window in sizes) <= 3
    padding = sum(4096 - size for size, window in sizes if size != window)
    assert padding < 0.02 * sum(size for size, _ in sizes)


def test_repeated_rows_null_ids_and_an_empty_table(spark, nothing):
    out = packed_pieces(frame(spark, [(1, "a b"), (1, "a b"), (None, "c"), (None, None)]), FILE, 2).collect()
    assert sorted((r.doc_id or 0, r.length) for r in out) == [(0, 1), (0, 2), (1, 3), (1, 3)]
    assert packed_pieces(nothing, FILE, 2).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_every_mixture_of_lengths(seed):
    rng = random.Random(seed)
    top = rng.choice([3, 40, 700, 3000, 20000])
    lengths = [rng.randint(1, top) for _ in range(rng.randint(1, 200))]
    sequences = packed(lengths, Packing().tiers)
    seen = defaultdict(list)
    for s in sequences:
        for doc, start, n in s.pieces:
            assert n > 0
            seen[doc].append((start, start + n))
    for doc, n in enumerate(lengths):
        spans = sorted(seen[doc])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(sum(p[2] for p in s.pieces) != s.window for s in sequences) <= 1


def test_whole_documents_where_possible():
    sequences = packed([4096, 3000, 1096, 600, 424], Packing().tiers)
    assert sorted(sorted(p[0] for p in s.pieces) for s in sequences) == [[0], [1, 2], [3, 4]]


def test_steps_are_balanced():
    rng = random.Random(1)
    sequences = packed([rng.randint(1, 5000) for _ in range(3000)], Packing().tiers)
    steps = steps_of(sequences, 65536)
    by_window = defaultdict(lambda: defaultdict(list))
    for s, step in zip(sequences, steps, strict=True):
        by_window[s.window][step].append(s)
    for window, own in by_window.items():
        counts = [len(x) for x in own.values()]
        assert max(counts) <= 65536 // window and max(counts) - min(counts) <= 1
        costs = [sum(s.cost() for s in x) / len(x) for x in own.values()]
        assert max(costs) < 1.3 * min(costs)
