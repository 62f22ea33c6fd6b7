"""The splitting tree of the cluster bootstrap."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelens.functions.hashing import seeded_key
from featurelens.operators import audits


@pytest.mark.parametrize("units,size", [(1, 4), (4, 4), (5, 4), (37, 4), (1000, 64), (9, 4096)])
def test_counts_add_up_and_are_fair(units, size):
    blocks = -(-units // size)
    counts = np.hstack([audits.block_draws(7, units, 2000, b, size) for b in range(blocks)])
    assert counts.shape == (2000, units) and (counts.sum(axis=1) == units).all()
    # Multinomial moments: mean 1, variance 1 - 1/n, covariance -1/n.
    assert np.abs(counts.mean(axis=0) - 1).max() < 0.15
    if units > 1:
        assert counts.var(axis=0).mean() == pytest.approx(1 - 1 / units, rel=0.05)
        assert np.cov(counts[:, 0], counts[:, -1])[0, 1] == pytest.approx(-1 / units, abs=0.1)


def test_more_replicates_keep_the_first():
    few, many = (audits.block_draws(3, 300, r, 2, 32) for r in (1, 5))
    assert few.shape == (1, 32) and (few[0] == many[0]).all()


def rows(spark, subjects=150):
    rng = np.random.default_rng(1)
    data = [(f"s{i}", float(x)) for i in range(subjects) for x in rng.normal(i % 5, 1, size=1 + i % 4)]
    data += [("s0", None), ("void", None)]
    return spark.createDataFrame(data, "subject string, loss double")


def test_means_equal_brute_force_over_the_same_counts(spark):
    table = rows(spark)
    got = {r.replicate: r for r in audits.bootstrap_means(table.repartition(7), "loss", "subject", 40, seed=2, block=16).collect()}
    units = table.groupBy("subject").agg(F.sum("loss").alias("s"), F.count("loss").alias("n"))
    units = units.withColumn("k", seeded_key(2, "subject")).orderBy("k").collect()
    s, n = np.array([u.s or 0.0 for u in units]), np.array([u.n for u in units])
    counts = np.hstack([audits.block_draws(2, len(units), 40, b, 16) for b in range(-(-len(units) // 16))])
    for r in range(40):
        assert got[r].draws == len(units) == 151
        assert got[r].mean == pytest.approx((counts[r] @ s) / (counts[r] @ n), abs=1e-12)
    whole = audits.cluster_bootstrap_tree(table, "loss", "subject", 40, seed=2, block=16).first()
    means = sorted(got[r].mean for r in got)
    assert (whole.low, whole.high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=1e-12)
    assert whole.units == 151 and whole.draws == 151 * 40


def test_agrees_with_draws_joined_one_by_one(spark):
    table = rows(spark)
    tree = audits.cluster_bootstrap_tree(table, "loss", "subject", 400, block=32).first()
    joined = audits.cluster_bootstrap(table, "loss", "subject", 400).first()
    width = joined.high - joined.low
    assert abs(tree.low - joined.low) < width / 4 and abs(tree.high - joined.high) < width / 4


def test_empty_table(spark):
    nothing = spark.createDataFrame([], "subject string, loss double")
    row = audits.cluster_bootstrap_tree(nothing, "loss", "subject", 5).first()
    assert (row.units, row.replicates, row.low) == (0, 0, None)
