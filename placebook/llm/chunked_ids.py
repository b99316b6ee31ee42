"""Token ids of texts, each distinct chunk encoded once.

A text is cut where a run of ASCII white space begins after a character that is no white space, and
between an ASCII letter and an ASCII sign. The tokenizers used here never join what stands on the
two sides of such places, so the ids of the chunks, one after the other, are the ids of the whole
text. Most chunks are words that come again and again; a worker encodes each once and copies its
ids. A chunk that is one word of Latin letters has nothing left to split or to normalise but its
case, and goes to the tokenizer's BPE model directly.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, islice

import numpy as np

from placebook.llm.words import SPACE, Texts, named


LETTER, SIGN = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), 0x7B, 0x7D, 0x7E]] = True  # 0x7C ends special tokens
#: Letters of ASCII and Latin-1: none of them changes under any Unicode normal form.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"


def chunk_starts(given: Texts) -> np.ndarray:
    data = given.data
    cut = SPACE[data]
    if len(cut):
        before = np.concatenate([np.zeros(3, np.uint8), data[:-1]])
        b3, b2, b1 = before[:-2], before[1:-1], before[2:]
        # White space beyond ASCII, by its first two bytes or by both of two.
        wide = (
            ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)))
            | ((b3 == 0xE1) & ((b2 == 0x9A) | (b2 == 0xA0)))
            | ((b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81)))
            | ((b3 == 0xE3) & (b2 == 0x80))
        )
        cut &= (b1 > 0x20) & ~wide
        cut[1:] |= LETTER[data[:-1]] & SIGN[data[1:]]
    cut[given.bounds[:-1][np.diff(given.bounds) > 0]] = True
    return np.flatnonzero(cut)


def _one_word(tokenizer) -> Callable[[str], str | None]:
    """What a chunk of one Latin word is to the BPE model of ``tokenizer``; null for other chunks.

    Told by what the tokenizer's own normaliser and splitter do to single letters, so that nothing
    is assumed about its kind; a tokenizer that treats words otherwise gets all chunks whole.
    """
    alphabet = [chr(c) for c in range(0x41, 0x100) if re.fullmatch(f"[{LATIN}]", chr(c))]

    def seen(text: str) -> list[str]:
        normal = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
        return [piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    table = {ord(c): seen(c) for c in alphabet}
    whole = "".join(alphabet)
    spaced = seen(" " + whole)
    if any(len(x) != 1 for x in table.values()) or len(spaced) != 1:
        return lambda chunk: None
    table = {c: x[0] for c, x in table.items()}
    mark = spaced[0].removesuffix(whole.translate(table))
    if mark + whole.translate(table) != spaced[0] or seen(whole) != [whole.translate(table)]:
        return lambda chunk: None
    # Where the space is kept it belongs to the word, and only one space does.
    pattern = re.compile(f"( ?)([{LATIN}]+)" if mark else f"([ \\t-\\r]*)([{LATIN}]+)").fullmatch

    def told(chunk: str) -> str | None:
        found = pattern(chunk)
        return (mark if found[1] else "") + found[2].translate(table) if found else None

    return told


class Encoder:
    """Ids of texts by a tokenizer file; remembers chunks, ``most`` at the most.

    Of too many the ``common`` that were met first are kept: words that come often come early.
    """

    def __init__(self, path: str, most: int = 400_000, common: int = 100_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word = _one_word(self.tokenizer)
        self.most, self.common = most, min(common, most // 4)
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.firsts = np.zeros(1, np.int64)

    def forget(self) -> None:
        """Drop all but the ``common`` chunks; a worker that waits for its next task holds no more."""
        if len(self.known) > self.common:
            self.known = dict(islice(self.known.items(), self.common))
            self.firsts = self.firsts[: self.common + 1].copy()
            self.flat = self.flat[: self.firsts[-1]].copy()

    def _learn(self, chunks: list[bytes]) -> None:
        coded: list[list[int]] = []
        others, places = [], []
        tokenize = self.tokenizer.model.tokenize
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            word = self.word(text)
            if word is None:
                places.append(len(coded))
                others.append(text)
                coded.append([])
            else:
                coded.append([token.id for token in tokenize(word)])
        for place, found in zip(places, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            coded[place] = found.ids
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        used = self.firsts[-1]
        total = int(sizes.sum())
        if used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(max(len(self.flat), total), np.uint32)])
        self.flat[used : used + total] = np.fromiter(chain.from_iterable(coded), np.uint32, total)
        for chunk in chunks:
            self.known[chunk] = len(self.known)
        self.firsts = np.concatenate([self.firsts, used + np.cumsum(sizes)])

    def ids(self, given: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts back to back, and each text's bounds."""
        starts = chunk_starts(given)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(given) + 1, np.int64)
        codes, pieces = named(given.data, np.diff(np.append(starts, len(given.data))))
        chunks = pieces.to_pylist()
        new = [c for c in chunks if c not in self.known]
        if new and len(self.known) + len(new) > self.most:
            self.forget()
            new = [c for c in chunks if c not in self.known]
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])
        place = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        first = self.firsts[place][codes]
        ends = np.cumsum(np.diff(self.firsts)[place][codes])
        shift = first - np.concatenate([[0], ends[:-1]])
        ids = self.flat[np.repeat(shift, np.diff(ends, prepend=0)) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, given.bounds)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end`` after each text."""
    count = len(bounds) - 1
    out = np.full(len(ids) + count, end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(count), np.diff(bounds))] = ids
    return out, bounds + np.arange(count + 1)
