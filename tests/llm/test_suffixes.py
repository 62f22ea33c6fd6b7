import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from awkward import SMOKE, docs, nothing, texts  # noqa: F401
from featurelens.llm import suffixes, words


def brute(texts, length=200):
    bodies = [(t or "").encode() for t in texts]
    found = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if found[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(b)]
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def check(df, texts):
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove(df).collect())
    assert got == sorted(brute(texts))


def test_remove_matches_brute_force(docs, nothing):
    check(docs, [r.text for r in docs.collect()])
    assert suffixes.remove(nothing).count() == 0 and suffixes.strip(nothing).count() == 0


def test_many_places_are_dealt_to_ranges(spark, monkeypatch):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdef ") for _ in range(260))
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 300))) + passage[rng.randint(0, 30) :] + "".join(rng.choice("gh ") for _ in range(rng.randint(0, 90))) for _ in range(50)]
    texts += ["ab" * 300, "ab" * 180, "z" * 199, "z" * 200, "q" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(df, texts)
    monkeypatch.setattr(suffixes, "MANY", 10)
    check(df, texts)


def test_large_collections_are_split_exactly(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n, letters="abcdef ": "".join(rng.choice(letters) for _ in range(n))
    passage = word(230)
    texts = [word(rng.randint(0, 60), "xyz ") + passage[: rng.randint(195, 230)] + word(rng.randint(0, 40), "uvw ") for _ in range(90)]
    texts += ["ab" * 300, "ab" * 180, "q" * 500, passage, passage, "q" * 260 + passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    for split, many, seen in ((3, 1 << 15, 1 << 18), (3, 10, 1 << 18), (0, 10, 5)):
        monkeypatch.setattr(suffixes, "SPLIT", split)
        monkeypatch.setattr(suffixes, "MANY", many)
        monkeypatch.setattr(suffixes, "SEEN", seen)
        check(df, texts)


def test_strip_keeps_rows_and_cuts_no_character(docs):
    out = suffixes.strip(docs, length="n_chars")
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = [r.text for r in docs.collect()]
    want = Counter(b.decode("utf-8", "ignore") if t is not None else None for t, (_, _, _, b) in zip(texts, brute(texts), strict=True))
    got = out.collect()
    assert Counter(r.text for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)


def test_common_starts_of_a_collection():
    rng = np.random.default_rng(4)
    members = rng.integers(97, 99, (60, 40)).astype(np.uint8)
    members[5, 30:] = suffixes.PAD
    groups = np.sort(rng.integers(0, 4, 60))
    got = suffixes.common_starts(members, groups, 33, length=8)
    for i in range(60):
        for c in range(33):
            window = members[i, c : c + 8]
            want = suffixes.PAD not in window and any(
                j != i and groups[j] == groups[i] and (members[j, c : c + 8] == window).all() for j in range(60)
            )
            assert got[i, c] == want


def test_equal_windows_elect_equal_anchors():
    rng = random.Random(9)
    passage = "".join(rng.choice("ab") for _ in range(210))
    texts = [f"{'x' * i}{passage}{'y' * (7 * i)}" for i in range(5)]
    data, offsets = words.raw(pa.array(texts))
    places, _ = suffixes.anchors(data, offsets)
    for i, text in enumerate(texts):
        at = text.index(passage)
        own = [p - offsets[i] - at for p in places.tolist() if offsets[i] + at <= p < offsets[i] + at + 210 - 63]
        assert own == [p - offsets[0] for p in places.tolist() if p < offsets[0] + 210 - 63]


def test_registered_query_matches_brute_force(spark):
    from featurelens.llm import queries

    table = spark.read.parquet(f"{SMOKE}/documents.parquet").orderBy("doc_id").collect()
    got = queries.QUERIES["op5_suffix_columns"](spark, SMOKE).orderBy("doc_id").collect()
    want = [(n, m, s, hashlib.sha256(b).hexdigest()) for n, m, s, b in brute([r.text for r in table])]
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want
