"""Tiled covariance and leading spectra against NumPy."""

import numpy as np
import pytest

from featurelens.operators import tiles
from featurelens.plans import registry


def frame(spark, x, parts=5):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "k long, features array<double>").repartition(parts)


@pytest.mark.parametrize("width,tile", [(7, 3), (7, 7), (7, 50), (12, 4), (1, 1)])
def test_strips_are_the_upper_tiles(spark, width, tile, monkeypatch):
    monkeypatch.setattr(tiles, "ROW_BYTES", 8 * width * 9)
    monkeypatch.setattr(tiles, "HELD_BYTES", 8 * tile * tile)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(83, width)) @ rng.normal(size=(width, width)) + 100
    want = np.cov(x.T, bias=True).reshape(width, width)
    strips = tiles.tiled_covariance(frame(spark, x), tile)
    seen = np.full((width, width), np.nan)
    for r in strips.collect():
        assert r.row // tile == r.row_tile <= r.column_tile
        a = r.column_tile * tile
        assert np.isnan(seen[r.row, a : a + len(r["values"])]).all()
        seen[r.row, a : a + len(r["values"])] = r["values"]
    upper = ~np.isnan(seen)
    assert np.allclose(seen[upper], want[upper], atol=1e-9) and upper[np.triu_indices(width)].all()
    sums = tiles.power_sums(strips, tile).first()
    values = np.linalg.eigvalsh(want)
    assert (sums.trace, sums.squares) == pytest.approx((values.sum(), (values**2).sum()))
    top = tiles.leading_spectrum(strips, 3, tile).orderBy("component").collect()
    assert len(top) == min(3, width)
    assert [r.eigenvalue for r in top] == pytest.approx(values[::-1][:3].tolist(), rel=1e-8)


def test_wide_features_leave_no_square_matrix_in_a_task(spark):
    rng = np.random.default_rng(3)
    width, tile = 1500, 256
    basis = rng.normal(size=(5, width))
    x = rng.normal(size=(60, 5)) * [9, 7, 5, 3, 2] @ basis + 0.01 * rng.normal(size=(60, width))
    strips = tiles.tiled_covariance(frame(spark, x), tile)
    assert strips.count() == sum(min(tile, width - i * tile) * (6 - i) for i in range(6))
    top = tiles.leading_spectrum(strips, 5, tile).orderBy("component").collect()
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:5] ** 2 / len(x)
    assert [r.eigenvalue for r in top] == pytest.approx(want.tolist(), rel=1e-9)
    assert max(r.residual for r in top) <= 1e-7 * want[0]


def test_registered_spectrum(spark):
    registry.load_all()
    sf = "/root/testdata/sf0.001"
    x = np.array([r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()], float)
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:4]
    got = registry.QUERIES["leading_spectrum"](spark, sf).orderBy("component").collect()
    for r, v in zip(got, want, strict=True):
        assert abs(r.eigenvalue - v) <= r.residual + 1e-9 and r.eigenvalue == pytest.approx(v, rel=1e-6)


def test_nothing_and_uneven_rows(spark):
    with pytest.raises(ValueError):
        tiles.tiled_covariance(spark.createDataFrame([], "features array<double>"))
    with pytest.raises(Exception):
        tiles.tiled_covariance(spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "features array<double>"))
