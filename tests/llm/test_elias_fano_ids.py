import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from placebook.llm.elias_fano_ids import File, Packed, Tokens, pack, read_back, write
from tests.llm.cases import collected, frame

FILE = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(FILE)
COLUMNS = ("doc_id", "start", "n_tokens", "ids_crc32")


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 2]


def expected(rows):
    start = 0
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = ids_of(text)
        yield doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("shards", [1, 5])
def test_round_trip(docs, rows, tmp_path, shards):
    files = write(docs, str(tmp_path), Tokens(FILE, 2), shards)
    assert collected(read_back(docs, str(tmp_path), files), *COLUMNS) == list(expected(rows))
    for width in (2, 4):
        folder = f"file://{tmp_path}/{width}"
        files = write(docs, folder, Tokens(FILE, 2, width), shards)
        texts, n = dict(rows), 0
        for f in files:
            file = File(folder, f.name)
            for k in range(file.n_docs):
                assert file.document(k).tolist() == ids_of(texts[file.doc_id(k)])
                n += 1
        assert n == len(rows)


def test_null_ids_copies_and_an_empty_table(spark, nothing, tmp_path):
    docs = frame(spark, [(5, "b"), (None, "x y"), (5, "a"), (-7, None), (5, "a"), (None, None)])
    files = write(docs, f"{tmp_path}/a", Tokens(FILE, 2), 2)
    out = sorted((r.start, r.doc_id, r.n_tokens) for r in read_back(docs, f"{tmp_path}/a", files).collect())
    assert [r[1:] for r in out] == [(None, 1), (None, 3), (-7, 1), (5, 2), (5, 2), (5, 2)]
    assert [r[0] for r in out] == [0, 1, 4, 5, 7, 9]
    assert read_back(nothing, f"{tmp_path}/b", write(nothing, f"{tmp_path}/b", Tokens(FILE, 2))).count() == 0


@pytest.mark.parametrize("count,top", [(0, 1), (1, 1), (1, 10**12), (511, 3), (513, 10**6), (5000, 5000), (20000, 10**15)])
def test_numbers_come_back(count, top):
    values = np.sort(np.random.default_rng(count).integers(-5, top, count))
    data = pack(values)
    got = Packed(data)
    assert got.select(0, count).tolist() == values.tolist()
    for i in range(0, count, max(1, count // 50)):
        assert got.select(i)[0] == values[i]
    if count > 1000:
        least = max(0.0, np.log2(top / count))
        assert len(data) * 8 < count * (least + 3.2) + 1000
