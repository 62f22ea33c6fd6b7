"""Retrieval through balls: exact, and without meetings that cannot matter."""

import numpy as np
import pytest

from featurelens.operators import balls, probes


def rings_of(centres, per, cosine, pivots=4):
    """Rings as the operator cuts them, made in NumPy."""
    chosen = centres[:pivots]
    away = np.sqrt(((centres[:, None] - chosen) ** 2).sum(axis=2))
    near, members, rows = away.argmin(axis=1), [], []
    for p in range(pivots):
        mine = np.flatnonzero(near == p)
        mine = mine[np.argsort(away[mine, p])]
        for i in range(0, len(mine), per):
            part = mine[i : i + per]
            rows.append((p * 100 + i, p, away[part, p].min(), away[part, p].max(), len(part)))
            members.append(part)
    columns = [np.array(c) for c in zip(*rows, strict=True)]
    return balls.Rings(chosen, *columns, np.sqrt((centres**2).sum(axis=1).max()), cosine), members


@pytest.mark.parametrize("cosine", [True, False])
@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e4])
def test_no_ring_that_matters_is_pruned(cosine, scale):
    rng = np.random.default_rng(4)
    hubs = rng.normal(size=(8, 5))
    centres = hubs[rng.integers(0, 8, 400)] + 0.05 * rng.normal(size=(400, 5))
    queries = scale * (hubs[rng.integers(0, 8, 300)] + 0.1 * rng.normal(size=(300, 5)))
    if cosine:
        centres /= np.linalg.norm(centres, axis=1)[:, None]
    close = queries @ centres.T if cosine else -((queries[:, None] - centres) ** 2).sum(axis=2)
    close = np.round(close, 12)
    own = rng.integers(0, 400, 300)
    score = close[np.arange(300), own]
    found, members = rings_of(centres, 10, cosine)
    visit, ahead = found.route(queries, score)
    ring_of = np.empty(400, int)
    for k, part in enumerate(members):
        ring_of[part] = k
    for q in range(300):
        assert visit[q, ring_of[np.flatnonzero(close[q] == close[q].max())]].all()
        seen = visit[q, ring_of]
        assert (close[q, seen] > score[q]).sum() + ahead[q] == (close[q] > score[q]).sum()
    if scale == 1.0:
        assert visit.mean() < 0.8  # own centroids are drawn at random, so ranks are far from 1


def tables(spark, hubs=30, per=20, asked=200, width=6, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(hubs, width))
    gallery = [(i, f"n{i:04d}", (middle[i % hubs] + 0.02 * rng.normal(size=width)).tolist()) for i in range(hubs * per)]
    queries = [
        (k, f"n{i:04d}", (middle[i % hubs] + 0.05 * rng.normal(size=width)).tolist())
        for k, i in enumerate(rng.integers(0, hubs * per, asked).tolist())
    ]
    schema = "key long, who string, features array<double>"
    return spark.createDataFrame(gallery, schema), spark.createDataFrame(queries, schema).repartition(3), gallery, queries


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_equal_to_brute_force_and_rings_are_skipped(spark, monkeypatch, metric):
    gallery, queries, centres, asked = tables(spark)
    monkeypatch.setattr(probes, "BLOCK_BYTES", 8 * 6 * 5)
    got = {r.key: r for r in probes.nearest_centroid(queries, gallery, "who", "key", metric).collect()}
    c = np.array([v for _, _, v in centres])
    if metric == "cosine":
        c /= np.linalg.norm(c, axis=1)[:, None]
    for k, name, v in asked:
        close = np.round(c @ v if metric == "cosine" else -((c - v) ** 2).sum(axis=1), 12)
        own = close[int(name[1:])]
        assert (got[k].prediction, got[k].true_rank) == (f"n{close.argmax():04d}", (close > own).sum() + 1)

    centroids = gallery.selectExpr("who as name", "features as centre")
    numbered, listed = balls.rings(centroids, False, 8 * 6 * 5)
    assert numbered.count() == listed.size.sum() == 600 and listed.size.max() <= 5 and len(listed.block) >= 120
    x = np.array([v for _, _, v in asked])
    visit, _ = listed.route(x, np.full(len(x), np.nan))
    assert visit.mean() < 0.1  # best matches alone meet few rings


def test_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(probes, "BLOCK_BYTES", 8 * 2 * 3)
    schema = "key long, who string, features array<double>"
    gallery = spark.createDataFrame([(i, f"n{i:02d}", [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)], schema)
    queries = spark.createDataFrame([(i, f"n{i:02d}", [1.0, 0.5]) for i in range(40)], schema)
    got = {r.key: (r.prediction, r.true_rank) for r in probes.nearest_centroid(queries, gallery, "who", "key").collect()}
    assert got == {i: ("n01", 1 if i % 2 else 21) for i in range(40)}
    assert probes.nearest_centroid(queries, gallery.limit(0), "who", "key").count() == 0
