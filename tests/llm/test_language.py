import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from awkward import SMOKE, docs, nothing, texts  # noqa: F401

from featurelens.llm import language, recurrent

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    tokens = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [" end"] for _, t in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]
    c = Counter(x for own, out in zip(tokens, held, strict=True) if not out for x in own)
    n, v = sum(c.values()), len(c)
    return n, sorted(
        (-1 if k is None else k, out, len(own), sum(c[x] > 0 for x in own), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in own), 6))
        for (k, _), own, out in zip(rows, tokens, held, strict=True)
    )


def base(rows):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows)


def test_base_scores_match_brute_force(docs, nothing, monkeypatch):  # noqa: F811
    n, want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for lexicon in (1 << 18, 40):
        monkeypatch.setattr(language.lexicon_of, "__defaults__", (24, lexicon))
        got = language.score(docs).collect()
        assert base(got) == want and {r.train_tokens for r in got} == {n}
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert language.score(nothing).count() == 0


def test_without_training_documents(spark):
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = language.score(spark.createDataFrame([(i, "a b") for i in out], "doc_id long, text string")).collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in rows] == [(0, 0, 0.0)] * 3


def test_held_out_documents_are_more_likely_than_under_the_base(spark):
    from featurelens.llm import queries

    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    got = queries.QUERIES["op3_recurrent_scores"](spark, SMOKE).collect()
    assert base(got) == brute(table)[1]
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.fixture(scope="module")
def small():
    counts = np.array([9.0, 7, 5, 3, 2, 1, 4, 2])
    lay = recurrent.layout(counts[:6], 2, classes=3)
    vector = recurrent.start(counts, lay, hidden=5).astype(np.float64)
    return lay, vector


def test_probabilities_sum_to_one(small):
    lay, vector = small
    model = recurrent.unpack(vector, lay, 5)
    states = np.random.default_rng(0).standard_normal((1, 5))
    total = sum(math.exp(recurrent.log_probabilities(model, lay, states, np.array([t]))[0]) for t in range(8))
    assert abs(total - 1) < 1e-9


def test_scores_carry_the_state_through_documents(small):
    lay, vector = small
    model = recurrent.unpack(vector, lay, 5)
    rng = np.random.default_rng(1)
    sizes = [40, 1, 7, 7, 1]
    first = np.concatenate(([0], np.cumsum(sizes)))
    token = rng.integers(0, 8, first[-1])
    states = recurrent.states_of(model, lay, token, first, end=0, hidden=5)
    for a, b in zip(first[:-1], first[1:], strict=True):
        state = np.zeros((1, 5), np.float32)
        for i in range(a, b):
            state = recurrent.step(model, np.array([token[i - 1] if i > a else 0]), state)[0]
            assert np.allclose(states[i], state[0], atol=1e-5)


def test_document_scores_are_sums_over_their_tokens(small):
    lay, vector = small
    model = recurrent.unpack(vector, lay, 5)
    rng = np.random.default_rng(3)
    sizes = [1, 90, 3, 3, 1, 17]
    first = np.concatenate(([0], np.cumsum(sizes)))
    token = rng.integers(0, 8, first[-1]).astype(np.uint16)
    states = recurrent.states_of(model, lay, token.astype(int), first, end=0, hidden=5)
    each = recurrent.log_probabilities(model, lay, states, token.astype(int))
    want = [each[a:b].sum() for a, b in zip(first[:-1], first[1:], strict=True)]
    for rows in (1, 7, 1 << 14):
        assert np.allclose(recurrent.document_scores(model, lay, token, first, 0, 5, rows), want, atol=1e-4)
    assert len(recurrent.document_scores(model, lay, token[:0], np.zeros(1, np.int64), 0, 5)) == 0


def test_scores_match_a_walk_word_by_word(spark):
    """``score`` of whole documents from the fitted parts, with a plain loop over tokens."""
    rng = np.random.default_rng(0)
    make = lambda n: " ".join(rng.choice(["red", "Green", "blue", "x1", "über", "end."], n))
    rows = [(i, make(1 + i % 40)) for i in range(60)] + [(60, make(5000)), (61, None), (61, None), (7, make(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = {}
    real = language.train
    language.train = lambda *a, **b: seen.setdefault("model", real(*a, **b))
    fit = language.lexicon_of
    language.lexicon_of = lambda v, *a: seen.setdefault("lexicon", fit(v, 4))
    try:
        got = language.score(docs).collect()
    finally:
        language.train, language.lexicon_of = real, fit
    (lexicon, counts, _), (lay, vector, _) = seen["lexicon"], seen["model"]
    model = recurrent.unpack(vector, lay)
    import pyarrow as pa

    from featurelens.llm import words

    want = []
    for key, text in rows:
        w = words.table(pa.array([text or ""]), lower=True)
        state, last, total = np.zeros((1, recurrent.HIDDEN), np.float32), lexicon.end, 0.0
        for word, kind in [*zip(w.key.tolist(), language.kinds(w).tolist(), strict=True), (None, None)]:
            at = np.flatnonzero(lexicon.key == np.uint64(word)) if word is not None else []
            token = lexicon.end if word is None else int(lexicon.token[at[0]]) if len(at) and lexicon.token[at[0]] >= 0 else lay.words + kind
            state = recurrent.step(model, np.array([last]), state)[0]
            total += recurrent.log_probabilities(model, lay, state, np.array([token]))[0] / math.log(10)
            if word is not None and token >= lay.words:
                count = int(lexicon.count[at[0]]) if len(at) else 0
                total += math.log10((count + 1) / (lexicon.kind_tokens[kind] + lexicon.kind_words[kind] + 1))
            last = token
        want.append((key, len(w.key) + 1, round(total, 2)))
    mine = sorted((r.doc_id, r.n_tokens, r.score) for r in got)
    for a, b in zip(mine, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-4, abs=0.02)


def test_gradients_match_differences(small):
    lay, vector = small
    rng = np.random.default_rng(2)
    before, token = rng.integers(0, 8, (3, 4)), rng.integers(0, 8, (3, 4))
    begins = np.zeros((3, 4), bool)
    begins[1, 2] = True

    def loss(v):
        model, total = recurrent.unpack(v, lay, 5), 0.0
        for s in range(3):
            state = np.zeros((1, 5))
            for t in range(4):
                state = recurrent.step(model, before[s, t : t + 1], state * (not begins[s, t]))[0]
                total -= recurrent.log_probabilities(model, lay, state, token[s, t : t + 1])[0]
        return total / 12

    trainer = recurrent.Trainer(vector, np.zeros_like(vector), lay, hidden=5)
    trainer.window(before, token, begins, np.zeros((3, 5)))
    # After one step from zero sums of squares, the sums are the squared gradients.
    for name in ("input", "loop", "classes", "class_bias", "words", "word_bias"):
        at = dict(zip((n for n, _ in recurrent.shapes(lay, 5)), np.cumsum([0, *(int(np.prod(s)) for _, s in recurrent.shapes(lay, 5))]), strict=False))[name]
        for i in range(at, at + 6):
            step = np.zeros_like(vector)
            step[i] = 1e-5
            slope = (loss(vector + step) - loss(vector - step)) / 2e-5
            assert abs(math.sqrt(trainer.squares[i]) - abs(slope)) < 1e-4
