import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from placebook.llm.chunked_ids import Encoder
from placebook.llm.words import texts
from tests.llm.cases import documents

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
WHOLE = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}
CHUNKED = {f: Encoder(public_tokenizers.path(f), most=5000) for f in FILES}


def same(file, given):
    ids, bounds = CHUNKED[file].ids(texts(pa.array(given, pa.string())))
    want = [e.ids for e in WHOLE[file].encode_batch([t or "" for t in given], add_special_tokens=False)]
    assert np.diff(bounds).tolist() == list(map(len, want))
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("file", FILES)
def test_awkward_texts(file):
    same(file, [t for _, t in documents()])


@pytest.mark.parametrize("file", FILES)
def test_given_texts(file):
    same(file, [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' limit 400").fetchall()])


PIECES = ["a", "B's", "é", "é", "̈", " ", "\u0085", " ", "　", " ", " ", "  ", "\n", "\t\r", "\x1c", "\x00", "12", "!?", "'ll", "日本", "😀", "Σ", "<|endoftext|>", "​", "᠎"]


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=6))
def test_any_mixture_of_spaces(file, drawn):
    same(file, [*drawn, None, ""])


@pytest.mark.parametrize("file", FILES)
def test_only_the_common_chunks_are_kept(file):
    encoder = Encoder(public_tokenizers.path(file), most=400, common=60)
    rows = [t for _, t in documents()]
    want = [e.ids for e in WHOLE[file].encode_batch([t or "" for t in rows], add_special_tokens=False)]
    for _ in range(2):
        assert encoder.ids(texts(pa.array(rows, pa.string())))[0].tolist() == [i for w in want for i in w]
        encoder.forget()
        assert len(encoder.known) == 60 and len(encoder.flat) == encoder.firsts[-1]
