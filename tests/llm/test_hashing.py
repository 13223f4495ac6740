import random
import re

import numpy as np
import pyarrow as pa
import pytest

hashing = pytest.importorskip("chainlens.llm.hashing")


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def test_words_and_sets_match_plain_python(monkeypatch):
    rng = random.Random(3)
    texts = ["", None, "a", " \n ", "A b a B", "é É\x0bx", "x" * 300]
    texts += ["".join(rng.choice("abAB é\n\t  .") for _ in range(rng.randrange(400))) for _ in range(200)]
    for piece in (hashing.PIECE, 64):
        monkeypatch.setattr(hashing, "PIECE", piece)
        column = pa.array(texts)
        hashes, offsets = hashing.word_hashes(column)
        known, back = {}, {}
        for i, text in enumerate(texts):
            mine = hashes[offsets[i]: offsets[i + 1]].tolist()
            plain = words_of(text)
            assert len(mine) == len(plain)
            for h, w in zip(mine, plain, strict=True):
                assert known.setdefault(w, h) == h
                assert back.setdefault(h, w) == w
        for text, found in zip(texts, hashing.shingle_sets(column, 5), strict=True):
            plain = words_of(text)
            expect = {tuple(plain[i: i + 5]) for i in range(max(1, len(plain) - 4))} if plain else set()
            assert len(found) == len(expect)


def test_sliced_column_keeps_its_rows():
    column = pa.array(["a b", "c d e", "f"])
    whole, at = hashing.word_hashes(column)
    part, _ = hashing.word_hashes(column.slice(1, 2))
    assert np.array_equal(part, whole[at[1]:])
