"""Leave-one-level-out monotone fits against a plain pool of all rows."""

import math

import numpy as np
import pytest

from featurelens.operators import audits, monotone


def fitted(x, y):
    """Max-min formula at the distinct values of x."""
    at = np.unique(x)
    s = np.array([y[x == v].sum() for v in at])
    n = np.array([(x == v).sum() for v in at])
    cs, cn = np.concatenate(([0], np.cumsum(s))), np.concatenate(([0], np.cumsum(n)))
    mean = lambda j, k: (cs[k + 1] - cs[j]) / (cn[k + 1] - cn[j])
    m = len(at)
    return at, np.array([max(min(mean(j, k) for k in range(i, m)) for j in range(i + 1)) for i in range(m)])


def brute(rows):
    x, y, level = (np.array(c) for c in zip(*rows, strict=True))
    out = {}
    for name in np.unique(level):
        at, value = fitted(x[level != name], y[level != name])
        own = level == name
        out[name] = (int(own.sum()), math.sqrt(((y[own] - np.interp(x[own], at, value)) ** 2).mean()))
    return out


@pytest.mark.parametrize("ranges", [1, 5, 40])
@pytest.mark.parametrize("shape", ["noisy", "rising", "falling", "flat"])
def test_matches_brute_force(spark, ranges, shape):
    rng = np.random.default_rng(8)
    slope = {"noisy": 0.5, "rising": 5.0, "falling": -5.0, "flat": 0.0}[shape]
    noise = {"noisy": 3.0, "rising": 0.0, "falling": 0.1, "flat": 0.0}[shape]
    rows = [
        (float(x), float(slope * x + noise * rng.normal()), f"l{i % 4 if i % 3 else 0}") for i, x in enumerate(rng.integers(0, 40, 160))
    ] + [(99.0, 1.0, "rare"), (-5.0, 2.0, "rare")]
    df = spark.createDataFrame(rows, "m double, t double, level string").repartition(6)
    got = {r.level: (r.runs, math.sqrt(max(r.mse, 0))) for r in monotone.leave_one_out(df, "m", "t", "level", ranges).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for name in want:
        assert got[name][0] == want[name][0] and got[name][1] == pytest.approx(want[name][1], abs=1e-6)


def test_one_level_nulls_and_empty(spark):
    schema = "m double, t double, level int"
    bad = [(None, 1.0, 1), (1.0, None, 1), (float("nan"), 1.0, 1), (1.0, 2.0, None)]
    alone = audits.isotonic_holdout(spark.createDataFrame([(1.0, 2.0, 7), *bad], schema), "m", "t", "level").collect()
    assert [tuple(r) for r in alone] == [(7, 1, None)]
    assert audits.isotonic_holdout(spark.createDataFrame(bad, schema), "m", "t", "level").count() == 0


def test_pools():
    one = np.ones(6)
    assert monotone.pooled(one, one, one, np.array([1, 3, 2, 2, 5, 4.0])) == [0, 1, 4]
    assert monotone.pooled(one, one, one, np.arange(6.0)) == [0, 1, 2, 3, 4, 5]
    assert monotone.pooled(one, one, one, -np.arange(6.0)) == [0]
