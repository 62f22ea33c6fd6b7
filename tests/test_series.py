"""Chunked signals give what whole recordings give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelens.operators import series


def signals():
    rng = np.random.default_rng(4)
    out = {"long": {i: float(x) for i, x in enumerate(rng.normal(size=90).cumsum())}, "one": {3: 1.0}}
    out["gaps"] = {int(i): float(rng.normal()) for i in rng.choice(60, 25, replace=False)}
    return out


@pytest.mark.parametrize("size", [1, 4, 7, 1000])
def test_lags_and_spectra_do_not_depend_on_chunks(spark, monkeypatch, size):
    monkeypatch.setattr(series, "CHUNK", size)
    data = signals()
    df = spark.createDataFrame([(r, f, v) for r, s in data.items() for f, v in s.items()], "recording_id string, frame_no long, x double")
    got = {(r.recording_id, r.lag): r for r in series.lag_statistics(df.repartition(5), "x", 5).collect()}
    want = {}
    for name, s in data.items():
        for lag in range(1, 6):
            pairs = [(v, s[f + lag]) for f, v in s.items() if f + lag in s]
            if pairs:
                want[name, lag] = pairs
    assert set(got) == set(want)
    for key, pairs in want.items():
        a, b = np.array(pairs).T
        assert got[key].pairs == len(pairs) and got[key].mean_change == pytest.approx(np.abs(a - b).mean())
        if len(pairs) > 2:
            assert got[key].autocorrelation == pytest.approx(np.corrcoef(a, b)[0, 1])
    power = {(r.recording_id, r.bin): (r.frames, r.power) for r in series.spectrum(df, "x", 3).collect()}
    for name, s in data.items():
        f, v = np.array(list(s)), np.array(list(s.values()))
        for b in (1, 2, 3):
            z = (v * np.exp(2j * np.pi * b * f / len(s))).sum()
            assert power[name, b][0] == len(s) and power[name, b][1] == pytest.approx(abs(z) ** 2 / len(s), abs=1e-9)


def test_band_of_self_similarity(spark, monkeypatch):
    monkeypatch.setattr(series, "CHUNK", 8)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    x[7] = 0
    df = spark.createDataFrame([("r", i, v.tolist()) for i, v in enumerate(x)], "recording_id string, frame_no long, v array<double>")
    got = {(r.frame_no, r.lag): r.similarity for r in series.self_similarity(df, "v", 11).collect()}
    assert set(got) == {(i, lag) for i in range(40) for lag in range(1, 12) if i + lag < 40}
    for (i, lag), s in got.items():
        if 7 in (i, i + lag):
            assert s is None
        else:
            assert s == pytest.approx(x[i] @ x[i + lag] / np.linalg.norm(x[i]) / np.linalg.norm(x[i + lag]))


def test_each_frame_moves_once(spark):
    df = spark.range(10_000).select(F.lit("r").alias("recording_id"), F.col("id").alias("frame_no"), F.col("id").cast("double").alias("x"))
    held = series.chunks(df, "x", halo=16)
    sizes = held.select(F.size("signal").alias("n"), F.size(F.filter("signal", lambda s: s["own"])).alias("own")).collect()
    # The chunk before the first frame holds a halo only.
    assert sum(r.own for r in sizes) == 10_000 and sum(r.n for r in sizes) == 10_000 + 16 * 20 and max(r.n for r in sizes) == 528
