import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from awkward import SMOKE
from featurelens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id long, wave long, slot int, score long, rank int"


def brute(rows, positives=5, k=10, every=100):
    """All anchors against all rows, one by one."""
    null_first = lambda i: (i is not None, i or 0)
    rows = [(n, i, [math.floor(256 * x) for x in v], label) for n, (i, v, label) in enumerate(rows)]
    out = []
    for n, i, v, label in rows:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), null_first(j), m, j, other) for m, j, w, other in rows if m != n)
        for score, _, _, j, _ in [s for s in scored if s[4] == label][:positives]:
            inside = [s for s in scored if s[4] != label and 30 * -score <= 100 * -s[0] <= 90 * -score][:k]
            out += [(i, j, r + 1, s[3], -score, -s[0]) for r, s in enumerate(inside)]
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is not None, x or 0) for x in r])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3, 4, 5) for i, v, label in rows], SCHEMA).repartition(5)


def table(seed, n, width=6, labels=4, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width))
    kinds = rng.integers(0, labels, n)
    return [(int(i), np.float32(centres[c] + spread * rng.normal(size=width)).tolist(), int(c)) for i, c in enumerate(kinds)]


def test_registered_query_matches_its_sql(spark):
    from featurelens.llm import queries

    for name in ("sf0.001", "sf0.1"):
        sf = SMOKE.replace("sf0.001", name)
        with duckdb.connect() as con:
            con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
            want = con.execute(negatives.SQL).fetchall()
        assert order(queries.QUERIES["op12_threshold_negatives"](spark, sf).collect()) == order(want)


def test_awkward_rows(spark):
    good = table(3, 230)
    twins = [(7, good[7][1], 1), (7, good[7][1], 1), (100, good[100][1], good[100][2]), (None, good[9][1], 2), (0, [0.0] * 6, 1)]
    bad = [None, [], [None] * 6, [float("nan")] * 6, [float("inf")] + [1.0] * 5, [1.0] * 5]
    unusable = [(200, v, 1) for v in bad] + [(300, [1.0] * 6, None)]
    got = negatives.mine(frame(spark, good + twins + unusable))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert order(got.collect()) == order(brute(good + twins))


def test_few_rows_and_large_entries(spark):
    assert negatives.mine(frame(spark, [])).count() == 0
    assert negatives.mine(frame(spark, [(100, [1.0, 0.0], 1)])).count() == 0
    assert negatives.mine(frame(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)])).count() == 0
    rows = [(100, [1e5, 3.0], 1), (1, [1e5, -2.0], 1), (2, [8e4, 5.0], 2), (3, [5e4, 1e3], 3), (4, [-1e5, 1.0], 2)]
    assert order(negatives.mine(frame(spark, rows)).collect()) == order(brute(rows))


def test_ties_and_negative_scores(spark):
    rows = [(i, [1.0, float(i % 2), 0.5], i % 3) for i in range(120)] + [(200, [-1.0, 0.0, 0.0], 0), (201, [1.0, 0.0, 0.0], 0)]
    assert order(negatives.mine(frame(spark, rows)).collect()) == order(brute(rows))


def test_lists_stop_early_without_losing_rows(monkeypatch):
    rows = table(5, 3000, width=3, labels=3, spread=0.2)
    ids, labels = (np.array([r[j] for r in rows], np.int64) for j in (0, 2))
    vectors = negatives.quantised(np.array([r[1] for r in rows]), 256.0)
    lists = negatives.Lists(ids, labels, vectors)
    whole = np.array([[-(1 << 63), (1 << 63) - 1]])
    for i in range(0, 3000, 300):
        allowed = (labels == labels[i]) & (ids != i)
        (found, scores), = lists.search(vectors[i], allowed, whole, 5)
        exact = vectors.astype(np.int64) @ vectors[i].astype(np.int64)
        want = sorted((-int(exact[j]), j) for j in np.flatnonzero(allowed))[:5]
        assert [(-int(s), int(j)) for j, s in zip(found, scores, strict=True)] == want
    assert lists.seen_rows < 10 * 3000 / 2


def test_blocks_and_waves_of_any_size(spark, monkeypatch):
    rows = table(11, 400)
    want = order(brute(rows, every=20))
    assert order(negatives.mine(frame(spark, rows), every=20).collect()) == want
    blocks = frame(spark, rows).select(F.col("vec_id").alias("id"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    packed = blocks.mapInArrow(negatives._pack(6, 256.0), negatives._BLOCKS).collect()
    assert sum(len(r.ids) // 8 for r in packed) == 400 and len({r.block for r in packed}) == len(packed)
    with pytest.raises(Exception):
        negatives.unpacked({"ids": b"", "labels": b"", "vectors": b"123"}, 6)
