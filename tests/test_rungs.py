"""Growing subsets from rungs, against NumPy on each subset."""

import hashlib

import numpy as np
import pytest

from featurelens.operators import geometry_stats


@pytest.mark.parametrize("fractions", [[0.2, 0.5, 1.0], [0.01, 0.02, 0.3], [1.0]])
def test_subsets_match_numpy(spark, fractions):
    rng = np.random.default_rng(6)
    x = {(c, p): rng.normal(c % 3, 1, 4) for c in range(25) for p in range(1 + c % 3 if c < 5 else 3)}
    rows = [(c, p, v.tolist()) for (c, p), v in x.items()]
    df = spark.createDataFrame(rows, "clip_id long, pos int, features array<double>").repartition(4)
    got = {(r["replicate"], r["size"]): r for r in geometry_stats.population_stability(df, fractions, 3, seed=2).collect()}
    sizes = {max(2, round(f * 25)) for f in fractions}
    assert set(got) == {(r, s) for r in range(3) for s in sizes}
    for r in range(3):
        order = sorted(range(25), key=lambda c: (hashlib.md5(f"2-{r}-{c}".encode()).hexdigest(), c))
        for s in sizes:
            chosen = order[:s]
            every = np.array([v for (c, _), v in x.items() if c in chosen])
            mu = every.mean(axis=0)
            total = ((every - mu) ** 2).sum() / len(every)
            means = {c: np.mean([v for (d, _), v in x.items() if d == c], axis=0) for c in chosen}
            count = {c: sum(d == c for d, _ in x) for c in chosen}
            between = sum(count[c] * ((means[c] - mu) ** 2).sum() for c in chosen) / len(every)
            assert got[r, s]["beta"] == pytest.approx(between / total, abs=1e-9)
            pooled = np.array([means[c] for c in chosen])
            values = np.clip(np.linalg.eigvalsh(np.cov(pooled.T, bias=True)), 0, None)
            share = values[values > 1e-13] / values.sum()
            assert got[r, s]["effective_rank"] == pytest.approx(np.exp(-(share * np.log(share)).sum()), rel=1e-6)
            assert got[r, s]["feature_std"] == pytest.approx(pooled.std(axis=0).mean(), rel=1e-9)
