import numpy as np
import pytest

from awkward import SMOKE
from featurelens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, key string, vector string, width int, deviation long"


def brute(rows, components=8):
    """Integer rows, exact deviations, eigenvalues and directions of the covariance."""
    x = np.floor(1024 * np.array([list(map(float, v)) for _, v in rows])).astype(np.int64) + 100_000
    n = len(x)
    off = n * x.astype(object) - x.astype(object).sum(axis=0)
    centred = (off / n).astype(np.float64)
    _, singular, right = np.linalg.svd(centred, full_matrices=True)
    values = np.zeros(x.shape[1])
    values[: len(singular)] = singular**2 / n
    return n, (off**2).sum(axis=1), centred, values, right[:components]


def compare(got, rows, components=8):
    n, deviation, centred, values, right = brute(rows, components)
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, {})[r.component] = r
    assert len(by_row) == len({i for i, _ in rows})
    for k in range(min(components, centred.shape[1])):
        want = centred @ right[k]
        live = values[k] > values[0] * 1e-25
        mine = np.array([by_row[i][k + 1].whitened if live else 0 for i, _ in rows], float)
        assert all((by_row[i][k + 1].whitened is None) != live for i, _ in rows)
        if live:
            want = want / np.sqrt(values[k])
            assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
            share = by_row[rows[0][0]][k + 1].explained
            assert share == pytest.approx(values[k] / values.sum(), rel=1e-9)
    for (i, _), d in zip(rows, deviation, strict=True):
        assert {r.deviation for r in by_row[i].values()} == {int(d)} and {r.n for r in by_row[i].values()} == {n}


def frame(spark, rows):
    full = [(i, v, None, 3, "k", "v", 4, 9) for i, v in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def test_registered_query_matches_numpy(spark):
    from featurelens.llm import queries

    table = spark.read.parquet(f"{SMOKE}/embeddings.parquet").collect()
    got = queries.QUERIES["op11_shifted_cholesky"](spark, SMOKE).collect()
    compare(got, [(r.vec_id, r.embedding) for r in table])
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_unusable_rows_are_left_out_and_repeats_stay(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf")] + [1.0] * 4, [1.0] * 4]
    repeated = [(1, good[1][1]), (None, good[2][1])]
    got = whitening.whiten(frame(spark, good + repeated + [(100 + i, v) for i, v in enumerate(bad)])).collect()
    assert len(got) == 42 * 5 and {r.component for r in got} == {1, 2, 3, 4, 5}
    rounded = [(i, np.float32(v).tolist()) for i, v in good + repeated]
    n, deviation, *_ = brute(rounded)
    assert {r.n for r in got} == {42} and n == 42
    assert sorted({r.deviation for r in got}) == sorted(set(map(int, deviation)))
    assert sum(r.vec_id is None for r in got) == 5 and sum(r.vec_id == 1 for r in got) == 10


def test_digits_of_small_components_survive(spark):
    rng = np.random.default_rng(7)
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    values = (rng.normal(size=(300, 6)) * [3e4, 3e2, 3e1, 1.0, 0.3, 0.1]) @ turn
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(values)]
    model = whitening.fit(frame(spark, rows), components=6)
    _, _, _, want, right = brute(rows)
    assert np.allclose(model.values, want, rtol=1e-9) and model.identity_error < 1e-4
    assert np.abs(np.abs((model.components * right.T).sum(axis=0)) - 1).max() < 1e-9


def test_dependent_and_constant_columns(spark):
    rng = np.random.default_rng(9)
    a, b = rng.integers(-9, 9, (2, 60))
    rows = [(i, [float(a[i]), float(b[i]), float(a[i]), 3.0]) for i in range(60)]
    got = whitening.whiten(frame(spark, rows)).collect()
    compare(got, rows)
    assert {r.component for r in got if r.whitened is None} == {3, 4} and got[0].identity_error < 1e-9
    assert {r.explained for r in got if r.component > 2} == {0.0}


def test_nothing_varies(spark):
    for rows in ([(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]):
        got = whitening.whiten(frame(spark, rows)).collect()
        assert len(got) == 2 * len(rows) and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(0, None, None, None)}
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, [(1, None)])).count() == 0


def test_large_entries(spark):
    rows = [(i, [float(i * 1e4), 1e30 if i == 4 else 0.0]) for i in range(6)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 12 and all(r.deviation is None for r in got)


def test_solve_inverts_factors():
    rng = np.random.default_rng(1)
    factors = [np.triu(rng.normal(size=(5, 5))) + 4 * np.eye(5) for _ in range(2)]
    rows = rng.normal(size=(30, 5))
    assert np.allclose(whitening.solve(rows @ factors[1] @ factors[0], [factors[0], factors[1]]), rows)
    gram = rows.T @ rows
    factor = whitening.cholesky(gram, shifted=False)
    assert np.allclose(factor.T @ factor, gram) and np.allclose(factor, np.triu(factor))
