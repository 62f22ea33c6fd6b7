"""One rule for vectors, wide draws, probes on missing values, package on the workers."""

import subprocess
import sys

import numpy as np
import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from featurelens.functions import vectors as vec
from featurelens.functions.hashing import draw_below, draw_uniform, seeded_key
from featurelens.operators import moments, probes


def tokens(spark, rows):
    return spark.createDataFrame([(i % 2, v) for i, v in enumerate(rows)], "clip long, features array<double>")


@pytest.mark.parametrize("width", [None, 3])
@pytest.mark.parametrize("bad", [None, [1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [1.0, None, 3.0]])
def test_null_unequal_and_partial_vectors_raise(spark, width, bad):
    df = tokens(spark, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], bad])
    with pytest.raises(Exception, match="expected a vector|imensions mismatch"):
        moments.vector_totals(df, [["clip"]], width).collect()


@pytest.mark.parametrize("bad", [None, [1.0, 2.0], [1.0, None, 3.0]])
def test_gram_refuses_them_too(spark, bad):
    df = tokens(spark, [[1.0, 2.0, 3.0], bad, [4.0, 5.0, 6.0]]).coalesce(1)
    with pytest.raises(Exception, match="expected a vector"):
        moments.gram(df).collect()


def test_both_sides_agree(spark):
    rows = np.random.default_rng(1).standard_normal((50, 3)).tolist()
    df = tokens(spark, rows)
    narrow, wide = (
        {r.clip: (r.tokens, np.round(r.total, 9).tolist()) for r in moments.vector_totals(df, [["clip"]], w).collect()} for w in (3, None)
    )
    assert narrow == wide


def test_draws_reach_beyond_32_bits(spark):
    bound = 10**11
    key = seeded_key(1, "id")
    row = (
        spark.range(20000)
        .select(draw_below(key, bound).alias("d"), draw_below(key, bound, 3).alias("e"), draw_uniform(key).alias("u"))
        .agg(F.max("d"), F.max("e"), F.min("d"), F.max("u"), F.min("u"))
        .first()
    )
    assert row[0] > 0.99 * bound and row[1] > 0.99 * bound and row[2] < 0.01 * bound
    assert row[3] < 1 and row[4] >= 0


def test_threshold_ignores_missing_values(spark):
    rows = [(1.0, "a"), (2.0, "a"), (3.0, "b"), (4.0, "b"), (None, "a"), (float("nan"), "a"), (None, "b")]
    df = spark.createDataFrame(rows, "x double, y string")
    cut = probes.threshold_probe(df, "x", "y", "a", "b")
    assert (cut.first().cut, cut.first().train_accuracy) == (2.5, 1.0)
    out = probes.apply_threshold(df, cut, "x", "a", "b").collect()
    assert sorted(str(r.prediction) for r in out) == ["None", "None", "None", "a", "a", "b", "b"]


def test_python_side_queries_run_from_another_folder(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "assert e.queries()['covariance_matrix'](spark, '/root/testdata/sf0.001').count() > 0\n"
        "assert e.queries()['score_clips'](spark, '/root/testdata/sf0.001').count() > 0\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]


def test_whole_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert df.select(vec.whole("v", 2)).first()[0] == [1.0, 2.0]


def test_zero_vectors_in_retrieval(spark):
    schema = "key long, who string, features array<double>"
    gallery = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 2.0]), (3, "z", [0.0, 0.0])], schema)
    queries = spark.createDataFrame(
        [(10, "a", [3.0, 1.0]), (11, "b", [3.0, 1.0]), (12, "a", [0.0, 0.0]), (13, "z", [0.0, 1.0]), (14, "new", [1.0, 1.0])], schema
    )
    got = {r.key: (r.prediction, r.true_rank) for r in probes.nearest_centroid(queries, gallery, "who", "key").collect()}
    assert got == {10: ("a", 1), 11: ("a", 2), 12: (None, None), 13: ("b", None), 14: ("a", None)}
    flat = {r.key: (r.prediction, r.true_rank) for r in probes.nearest_centroid(queries, gallery, "who", "key", "euclidean").collect()}
    assert flat[12] == ("z", 2) and flat[13] == ("b", 1)


def test_many_blocks_give_the_same_ranks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    schema = "key long, who string, features array<double>"
    gallery = spark.createDataFrame([(i, f"n{i:03d}", rng.standard_normal(6).tolist()) for i in range(60)], schema)
    queries = spark.createDataFrame([(i, f"n{i % 60:03d}", rng.standard_normal(6).tolist()) for i in range(90)], schema)
    whole = sorted(probes.nearest_centroid(queries, gallery, "who", "key").collect())
    monkeypatch.setattr(probes, "BLOCK_BYTES", 8 * 6 * 7)
    assert sorted(probes.nearest_centroid(queries, gallery, "who", "key").collect()) == whole


def test_shards_below_a_path_without_scheme(spark, tmp_path):
    from featurelens.sources import frames
    from featurelens.sources.paths import opened, qualified

    assert qualified(spark, str(tmp_path)).startswith("file:")
    with pytest.raises(ValueError):
        opened("/no/scheme")
    members = spark.createDataFrame([(f"m{i:02d}.npy", bytes([i]) * 9) for i in range(20)], "member string, payload binary")
    frames.write_tar_shards(members, str(tmp_path), 3)
    back = frames.scan_tar_shards(spark, f"{tmp_path}/*.tar.gz").collect()
    assert sorted((r.member, r.payload) for r in back) == sorted((r.member, r.payload) for r in members.collect())
