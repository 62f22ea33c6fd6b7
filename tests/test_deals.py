"""The permutation null against NumPy, in every layout of the fold."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelens.operators import deals, geometry_stats


def rows(clips, positions, width, seed=3, missing=()):
    rng = np.random.default_rng(seed)
    return [
        (f"c{c:03d}", p, rng.normal(size=width).round(3).tolist())
        for c in range(clips)
        for p in range(positions)
        if (c, p) not in missing
    ]


def table(spark, data, parts=5):
    return spark.createDataFrame(data, "clip_id string, pos int, features array<double>").repartition(parts)


def brute(data, replicates, seed=0):
    x = {(c, p): np.array(v) for c, p, v in data}
    every = np.array(list(x.values()))
    mu = (every.mean(axis=0) ** 2).sum()
    total = (every**2).sum() / len(every) - mu
    out = {}
    for r in range(replicates):
        sums, counts = {}, {}
        for p in {p for _, p in x}:
            named = sorted(c for c, q in x if q == p)
            drawn = sorted(named, key=lambda c: (hashlib.md5(f"{seed}-{r}-{p}-{c}".encode()).hexdigest(), c))
            for giver, taker in zip(named, drawn, strict=True):
                sums[taker] = sums.get(taker, 0) + x[giver, p]
                counts[taker] = counts.get(taker, 0) + 1
        between = sum((s**2).sum() / counts[c] for c, s in sums.items()) / len(every) - mu
        out[r] = (between, between / total)
    return out


def close(got, want):
    assert {r.replicate for r in got} == set(want)
    for r in got:
        assert (r.trace_between, r.beta) == pytest.approx(want[r.replicate], abs=1e-9)


def test_hundred_replicates(spark):
    data = rows(9, 12, 5)
    close(geometry_stats.permutation_null(table(spark, data), 100, width=5).collect(), brute(data, 100))


@pytest.mark.parametrize("held", [9 * 8 * 3 * 2, 9 * 8 * 2, 9 * 8, 8])
def test_pieces_parts_and_sums_passed_on(spark, monkeypatch, held):
    """Narrow pieces, then few replicates at a time, then no held sums at all."""
    monkeypatch.setattr(deals, "FOLD_BYTES", held)
    data = rows(9, 6, 5, missing={(0, 1), (4, 5), (4, 0)})
    for parts in (1, 7):
        close(geometry_stats.permutation_null(table(spark, data, parts), 3, seed=4).collect(), brute(data, 3, 4))


def test_sums_do_not_grow_with_positions(spark):
    made = {}
    for positions in (8, 64):
        tokens = table(spark, rows(6, positions, 4))
        dealt, clips = deals.deals(tokens, 10, 0)
        made[positions] = deals.dealt_sums(tokens, dealt, clips, 10, 4, blocks=2).count()
        plan = deals.dealt_sums(tokens, dealt, clips, 10, 4, blocks=2)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan
    assert made[8] == made[64] == 2 * 10 * 6


def test_counts_follow_the_deal(spark):
    data = rows(5, 7, 2, missing={(2, 3)})
    tokens = table(spark, data)
    dealt, clips = deals.deals(tokens, 4, 1)
    assert clips == 5
    sums = deals.dealt_sums(tokens, dealt, clips, 4, 2).groupBy("replicate", "clip").agg(F.sum("tokens").alias("n")).collect()
    assert sorted(r.n for r in sums) == sorted([7, 7, 6, 7, 7] * 4)
