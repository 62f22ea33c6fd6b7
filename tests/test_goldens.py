"""Published values and brute-force NumPy results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelens.operators import audits, clips, inventory, moments, paired, probes, series, windows
from featurelens.operators import geometry_stats as geo


def vectors(spark, array, **columns):
    rows = [
        (i, *[c[i] for c in columns.values()], [float(x) for x in v]) for i, v in enumerate(array)
    ]
    names = ["id", *columns, "features"]
    return spark.createDataFrame(rows, names)


def rank_of(x):
    values = np.clip(np.linalg.eigvalsh(np.cov(x, rowvar=False)), 0, None)
    p = values[values > 0] / values.sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def test_constant_features_have_no_rank(spark):
    row = moments.spectral_stats(vectors(spark, np.ones((32, 8)))).first()
    assert row["effective_rank"] == 0.0 and row["feature_std"] == 0.0


def test_rank_and_penalties_match_numpy(spark):
    x = np.random.default_rng(0).normal(size=(512, 8))
    row = moments.spectral_stats(vectors(spark, x).repartition(5)).first()
    assert row["effective_rank"] > 6 and row["feature_std"] > 0.5
    assert row["effective_rank"] == pytest.approx(rank_of(x), rel=1e-9)
    cov = np.cov(x, rowvar=False)
    off = cov - np.diag(np.diag(cov))
    assert row["covariance_loss"] == pytest.approx((off**2).sum() / 8, rel=1e-9)
    hinge = np.maximum(1 - np.sqrt(x.var(axis=0) + 1e-4), 0).mean()
    assert row["variance_loss"] == pytest.approx(hinge, rel=1e-9)


def test_large_mean_does_not_hide_small_spread(spark):
    x = np.random.default_rng(1).normal(size=(400, 6)) + 1000.0
    row = moments.spectral_stats(vectors(spark, x)).first()
    assert row["effective_rank"] == pytest.approx(rank_of(x), rel=1e-4)


def token_table(spark, grid):
    clips_n, positions, _ = grid.shape
    rows = [
        (c, p, [float(v) for v in grid[c, p]]) for c in range(clips_n) for p in range(positions)
    ]
    return spark.createDataFrame(rows, "clip_id long, pos long, features array<double>")


def test_scores_example(spark):
    grid = np.array([[[90.0], [70.0]], [[40.0], [20.0]]])
    row = geo.position_share(token_table(spark, grid)).first()
    assert row["trace_total"] == pytest.approx(725)
    assert row["trace_clip"] == pytest.approx(625)
    assert row["trace_within"] == pytest.approx(100)


def test_published_floors(spark):
    rows = [
        ("random", 0.01312, 53.04459, 1.8985, 10.8),
        ("a00", 0.00882, 13.97784, 1.15613, 12.0),
        ("b02", 1.73164, 14.90398, 1.07194, 2533.0),
    ]
    traces = spark.createDataFrame(
        [(n, 1568, c, w, r) for n, c, w, r, _ in rows],
        "model string, positions_per_clip long, trace_clip double, trace_within double, trace_residual double",
    )
    found = {r["model"]: r["observed_over_corrected"] for r in geo.leakage_floor(traces).collect()}
    for name, *_, expected in rows:
        assert found[name] == pytest.approx(expected, rel=5e-3)


def test_variance_decomposition_matches_numpy(spark):
    grid = np.random.default_rng(2).normal(size=(40, 6, 5)) + np.arange(40)[:, None, None] * 0.05
    row = geo.variance_decomposition(token_table(spark, grid).repartition(7)).first()
    means = grid.mean(axis=1)
    between = np.cov(means, rowvar=False, bias=True)
    dev = (grid - means[:, None]).reshape(-1, 5)
    within = dev.T @ dev / len(dev)
    assert row["trace_between"] == pytest.approx(np.trace(between), rel=1e-9)
    assert row["trace_within"] == pytest.approx(np.trace(within), rel=1e-9)

    def spectral(m):
        w = np.clip(np.linalg.eigvalsh(m), 0, None)
        p = w[w > 0] / w.sum()
        return np.exp(-(p * np.log(p)).sum())

    assert row["rank_token"] == pytest.approx(spectral(between + within), rel=1e-9)
    assert row["rank_between"] == pytest.approx(spectral(between), rel=1e-9)
    assert row["rank_within"] == pytest.approx(spectral(within), rel=1e-9)


def test_unequal_clips_are_refused(spark):
    ragged = spark.createDataFrame(
        [(0, 0, [1.0]), (0, 1, [2.0]), (1, 0, [3.0])], "clip_id long, pos long, features array<double>"
    )
    with pytest.raises(Exception, match="unequal token counts"):
        geo.position_share(ragged).collect()
    row = geo.weighted_shares(ragged).first()
    assert row["trace_total"] == pytest.approx(np.var([1, 2, 3]))


@pytest.mark.parametrize(
    "subjects,fraction,expected", [(8, 0.25, (2, 1)), (398, 0.2, (80, 40))]
)
def test_split_sizes(subjects, fraction, expected):
    assert inventory.split_sizes(subjects, fraction) == expected


@pytest.mark.parametrize("arguments", [(2, 0.2), (10, 1.0), (10, 0.2, 0.2), (3, 0.99)])
def test_split_sizes_refuse(arguments):
    with pytest.raises(ValueError):
        inventory.split_sizes(*arguments)


def test_window_starts(spark):
    df = spark.createDataFrame([("r", 8), ("short", 3)], "recording_id string, num_frames int")
    starts = windows.eval_windows(df, 4, 3).orderBy("window_index").collect()
    assert [r["window_start"] for r in starts] == [0, 2, 4]
    assert windows.eval_windows(df, 4).first()["window_start"] == 2


def test_accumulation_sizes(spark):
    batches = spark.range(10).withColumnRenamed("id", "batch")
    sizes = windows.accumulation_sizes(batches, 10, 4).orderBy("batch").collect()
    expected = [4] * 8 + [2, 2]
    assert [r["accumulation_size"] for r in sizes] == expected
    with pytest.raises(ValueError):
        windows.accumulation_sizes(batches, 10, 0)


def test_train_windows_change_with_the_epoch(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("recording_id"), F.lit(100).alias("num_frames"))
    def start(epoch):
        return {r["recording_id"]: r["window_start"] for r in windows.train_windows(df, 16, epoch).collect()}
    assert start(0) == start(0)
    assert start(0) != start(1)
    assert all(0 <= s <= 84 for s in start(0).values())


# Published table: token rank, pooled rank (two populations), beta, retrieval.
RUNS = {
    "a01": (36.95, 9.08, 9.08, 0.00087, 0.0282),
    "a02": (123.59, 4.59, 4.96, 0.00201, 0.0282),
    "a05": (78.62, 11.89, 8.25, 0.00051, 0.0288),
    "a00": (60.32, 10.86, 9.83, 0.00063, 0.0294),
    "a03": (21.55, 5.95, 5.41, 0.00043, 0.0300),
    "a04": (55.14, 10.59, 9.99, 0.00073, 0.0306),
    "a06": (59.71, 10.69, 9.73, 0.00063, 0.0306),
    "b01": (112.93, 14.42, 11.85, 0.00052, 0.0325),
    "b00": (46.76, 6.52, 27.08, 0.04159, 0.0343),
    "a07": (40.88, 5.13, 19.76, 0.02971, 0.0404),
    "b02": (63.39, 23.60, 77.98, 0.10409, 0.0484),
}


def test_published_rank_correlations(spark):
    names = ["token", "pooled_small", "pooled_large", "beta"]
    metrics = spark.createDataFrame(
        [(run, n, row[i]) for run, row in RUNS.items() for i, n in enumerate(names)],
        "run_id string, metric string, value double",
    )
    transfer = spark.createDataFrame(
        [(run, row[4]) for run, row in RUNS.items()], "run_id string, transfer double"
    )
    found = {r["metric"]: r["spearman"] for r in audits.rank_correlation(metrics, transfer).collect()}
    expected = dict(zip(names, (-0.100, 0.260, 0.890, 0.446)))
    for name, value in expected.items():
        assert found[name] == pytest.approx(value, abs=5e-4)


def test_rank_correlation_of_a_constant_metric(spark):
    rows = [(i, "flat", 9.0) for i in range(5)] + [(i, "rising", float(i)) for i in range(5)] + [(0, "single", 1.0)]
    metrics = spark.createDataFrame(rows, "run_id long, metric string, value double")
    transfer = spark.createDataFrame([(i, float(i * i)) for i in range(5)], "run_id long, transfer double")
    found = {r["metric"]: r for r in audits.rank_correlation(metrics, transfer).collect()}
    assert np.isnan(found["flat"]["spearman"]) and np.isnan(found["flat"]["pearson"]) and found["flat"]["runs"] == 5
    assert found["rising"]["spearman"] == pytest.approx(1.0)
    assert found["rising"]["pearson"] == pytest.approx(np.corrcoef(range(5), np.arange(5.0) ** 2)[0, 1])
    assert found["single"]["pearson"] is None


def test_constant_sides_have_no_correlation(spark):
    losses = spark.createDataFrame(
        [(i, c, 1.0 if c == "a" else float(i)) for i in range(4) for c in "ab"], "subject_id long, condition string, loss double"
    )
    assert np.isnan(audits.label_reliability(losses, "a", "b").first()["reliability"])
    frames = spark.createDataFrame([("r", f, 2.0) for f in range(4)], "recording_id string, frame_no long, x double")
    found = {r["lag"]: r["autocorrelation"] for r in series.lag_statistics(frames, "x", 3).collect()}
    assert np.isnan(found[1]) and np.isnan(found[2]) and found[3] is None


def test_kendall_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 12, 150), rng.integers(0, 9, 150)
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "k long, x long, y long")
    signs = np.sign(x[:, None] - x[None]) * np.sign(y[:, None] - y[None])
    upper = np.triu_indices(150, 1)
    row = audits.kendall(df, "x", "y", "k").first()
    assert row["concordant"] == (signs[upper] > 0).sum()
    assert row["discordant"] == (signs[upper] < 0).sum()


@pytest.mark.parametrize("limit", [3, 1000])
def test_kendall_sorts_distinct_rows_in_slices(spark, monkeypatch, limit):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 6, 400), rng.normal(size=400).round(1)
    df = spark.createDataFrame([(i % 9, int(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k long, x long, y double")
    sorted_index, seen = audits.sorted_index, []

    def counted(rows, *args, **options):
        seen.append(rows.count())
        return sorted_index(rows, *args, **options)

    monkeypatch.setattr(audits, "sorted_index", counted)
    monkeypatch.setattr(audits, "KENDALL_SLICE", limit)
    signs = np.sign(x[:, None] - x[None]) * np.sign(y[:, None] - y[None])
    upper = np.triu_indices(400, 1)
    row = audits.kendall(df, "x", "y", "k").first()
    assert (row["runs"], row["concordant"]) == (400, (signs[upper] > 0).sum())
    assert row["discordant"] == (signs[upper] < 0).sum()
    cells = len(set(zip(x.tolist(), y.tolist())))
    assert seen[:2] == [len(set(y.tolist())), cells] and seen[2] == cells * int(np.ceil(np.log2(cells)))


def test_probe_is_at_the_optimum(spark):
    """The gradient of the penalised, balanced loss vanishes at the fitted weights."""
    rng = np.random.default_rng(4)
    y = (rng.random(300) < 0.3).astype(int)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.1, 1] + y[:, None] * [0.5, 1, 0, 0]
    df = vectors(spark, x, label=[f"c{v}" for v in y])
    fitted = probes.fit_probe(df, "label", tolerance=1e-10)
    w, b = fitted.model.coefficients.toArray(), fitted.model.intercept
    z = (x - x.mean(0)) / x.std(0)
    weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    residual = weight * (1 / (1 + np.exp(-(z @ w + b))) - y)
    assert np.abs(z.T @ residual + w).max() < 1e-3
    assert abs(residual.sum()) < 1e-3


def test_probe_scales_constant_columns_by_one(spark):
    x = np.column_stack([np.full(40, 3.0), np.r_[np.zeros(20), np.ones(20)]])
    df = vectors(spark, x, label=["a"] * 20 + ["b"] * 20)
    scored = probes.fit_probe(df, "label")(df)
    assert scored.filter("label = prediction").count() == 40


def test_metrics_by_hand(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] + [("b", "c")]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    row = probes.classification_metrics(df, "label", "t", 10).first()
    assert (row["val_examples"], row["num_classes"], row["train_examples"]) == (6, 2, 10)
    assert row["majority_baseline"] == pytest.approx(4 / 6)
    assert row["accuracy"] == pytest.approx(4 / 6)
    assert row["balanced_accuracy"] == pytest.approx((3 / 4 + 1 / 2) / 2)
    assert row["macro_f1"] == pytest.approx((6 / 7 + 2 / 4 + 0) / 3)


def test_single_source_subject_is_refused(spark):
    df = spark.createDataFrame([("s", "v1"), ("t", "v1"), ("t", "v2")], "subject_id string, source_video_id string")
    with pytest.raises(Exception, match="two sources"):
        probes.source_holdout(df).collect()


def test_best_checkpoint_ties_and_nan(spark):
    rows = [("r", 1, float("nan")), ("r", 2, 0.5), ("r", 3, 0.5), ("r", 4, None)]
    df = spark.createDataFrame(rows, "run_id string, epoch long, loss double")
    row = probes.best_checkpoint(df).first()
    assert (row["best_epoch"], row["best_loss"], row["last_epoch"]) == (2, 0.5, 4)


def test_selectivity_and_spectrum_match_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(30, 6)), rng.normal(size=(30, 6)) @ np.diag([3, 2, 1, 0.1, 0.1, 0.1])
    families = {n: vectors(spark, m, subject_id=[str(i) for i in range(30)]) for n, m in (("a", a), ("b", b))}
    spectrum = paired.displacement_spectrum(families["a"]).orderBy("component").collect()
    assert [r["singular_value"] for r in spectrum] == pytest.approx(list(np.linalg.svd(a)[1]), rel=1e-9)
    found = {(r["displacement"], r["span"]): r["energy_share"] for r in paired.selectivity(families, 2).collect()}
    basis = np.linalg.svd(b)[2][:2]
    assert found[("a", "b")] == pytest.approx(((a @ basis.T) ** 2).sum() / (a**2).sum(), rel=1e-9)
    assert found[("a", "a")] <= 1.0


def test_resample_keeps_constants_and_range():
    for size_in, size_out in ((7, 20), (20, 7), (5, 5), (64, 3)):
        weights = clips._resample(size_in, size_out)
        assert weights.shape == (size_out, size_in)
        assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all()


def test_isotonic_fit_is_scored_per_level(spark):
    rows = [(float(i), float(i) ** 2, f"l{i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "m double, t double, level string")
    out = audits.isotonic_holdout(df, "m", "t", "level", ["l0", "l1", "l2"]).collect()
    assert len(out) == 3 and all(r["runs"] == 10 for r in out)
    exact = audits.quadratic_holdout(df, "m", "t", "level").collect()
    assert max(r["quadratic_rmse"] for r in exact) < 1e-6
