import re

import numpy as np
import pyarrow as pa

from awkward import texts  # noqa: F401
from featurelens.llm import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_match_the_pattern(texts):
    w = words.table(pa.array([*texts, "a\x0bb\x1cc d", None], pa.string()))
    expected = [WORD.findall(t or "") for t in [*texts, "a\x0bb\x1cc d", None]]
    assert np.diff(w.first).tolist() == [len(e) for e in expected]
    assert [w.text(i) for i in range(len(w.key))] == [x for e in expected for x in e]
    by_key = {}
    for i, key in enumerate(w.key.tolist()):
        assert by_key.setdefault(key, w.text(i)) == w.text(i)
    assert len(by_key) == len({x for e in expected for x in e})


def test_blocks_cover_all_rows(texts):
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["i", "text"])
    parts = list(words.blocks(batch, limit=500))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    sliced = words.table(batch.slice(5, 7).column(1))
    assert sliced.key.tolist() == words.table(pa.array(texts[5:12])).key.tolist()
    assert list(words.blocks(batch.slice(0, 0))) == []


def test_shingles_are_those_of_equal_words():
    w = words.table(pa.array(["a b c d", "b c d"]))
    assert words.shingle_keys(w.key, 3)[[1, 4]].tolist() == [words.shingle_keys(w.key, 3)[1]] * 2
    assert len(words.shingle_keys(w.key[:2], 3)) == 0
