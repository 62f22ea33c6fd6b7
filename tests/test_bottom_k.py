"""The first rows of seeded orders, kept by tasks before the shuffle."""

import hashlib

import pytest
from pyspark.sql import functions as F

from featurelens.functions.hashing import seeded_key
from featurelens.functions.ranking import bottom_k, seeded_index
from featurelens.operators import geometry_stats
from featurelens.session import adapt


def rows(spark, n=3000, groups=3):
    return spark.range(n).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % groups).alias("g"), "id")


@pytest.mark.parametrize("k", [0, 1, 5, 1500, 5000])
def test_equal_to_ranking_all_rows(spark, k):
    adapt(spark)
    df, key = rows(spark).repartition(7), seeded_key(3, "g", "id")
    got = sorted(map(tuple, bottom_k(df, ["g"], key, ["id"], k).select("g", "id", "draw").collect()))
    whole = seeded_index(df, ["g"], key, ["id"], out="draw").filter(F.col("draw") < k)
    assert got == sorted(map(tuple, whole.select("g", "id", "draw").collect()))


def test_only_k_rows_of_a_task_move(spark):
    adapt(spark)
    df = rows(spark).repartition(6)
    out = bottom_k(df, ["g"], seeded_key(3, "g", "id"), ["id"], 2000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("WindowGroupLimit") :]
    assert "Partial" in below and plan.count("WindowGroupLimit") == 2
    # The limit of the tasks stands below the exchange by group.
    assert below.index("hashpartitioning(g") < below.index("Partial")


def test_samples_fill_batches_in_order(spark):
    df = rows(spark).withColumnRenamed("g", "batch")
    got = geometry_stats.sample_tokens(df, "batch", ["id"], 40, 100, seed=5).collect()
    key = lambda b, i: hashlib.md5(f"5-{b}-{i}".encode()).hexdigest()
    want = []
    for b in range(3):
        ids = sorted((i for i in range(3000) if (0 if i % 2 == 0 else i % 3) == b), key=lambda i: (key(b, i), i))
        want += [(b, i, d) for d, i in enumerate(ids[:40])]
    assert sorted((r.batch, r.id, r.draw) for r in got) == sorted(want[:100])
