"""Frames held in buckets: windows meet them without moving pixels."""

import re

import pytest
from pyspark.sql import functions as F

from featurelens.config import ClipConfig
from featurelens.operators import clips, export
from featurelens.plans import views

SMOKE = "/root/testdata/sf0.001"
CONFIG = ClipConfig(num_frames=4, img_size=8, patch_size=4, windows=2, foreground_crop=False)


@pytest.fixture
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def ancestors(plan: str, leaf: str) -> list[str]:
    """The operators above the line that holds ``leaf``, nearest first."""
    lines = plan.split("\n")
    depth = lambda line: re.search(r"[A-Za-z*]", line).start() if re.search(r"[A-Za-z*]", line) else 0
    at = next(i for i, line in enumerate(lines) if leaf in line and "Scan" in line)
    out, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if line.strip() and depth(line) < level:
            out.append(line.strip(" +-:"))
            level = depth(line)
    return out


def inputs(spark):
    frames = views.pixel_frames(spark, SMOKE)
    manifest = frames.select("recording_id").distinct().withColumn("split", F.lit("test")).withColumn("num_frames", F.lit(0))
    return manifest, frames


def test_no_exchange_above_the_pixels(spark, shuffled_joins):
    manifest, frames = inputs(spark)
    _, rendered = export.export_clips(manifest, frames, CONFIG)
    plan = rendered._jdf.queryExecution().executedPlan().toString()
    above = ancestors(plan, "pixels#")
    joined = next(i for i, line in enumerate(above) if "Join" in line)
    assert not any("Exchange" in line for line in above) and joined >= 0
    scan = next(line for line in plan.split("\n") if "pixels#" in line and "Scan" in line)
    assert "Bucketed: true" in scan or "SelectedBucketsCount" in scan


def test_held_frames_serve_every_epoch(spark, shuffled_joins):
    manifest, frames = inputs(spark)
    held = export.hold_frames(frames, CONFIG, buckets=3)
    assert held.inputFiles() and len(held.inputFiles()) <= 3
    for epoch in (None, 0, 1):
        got = export.export_clips(manifest, held, CONFIG, epoch)[1]
        want = export.export_clips(manifest, frames, CONFIG, epoch)[1]
        keys = [*export.KEYS, "clip_offset", F.hex("pixels").alias("pixels")]
        assert sorted(map(tuple, got.select(*keys).collect())) == sorted(map(tuple, want.select(*keys).collect()))
    features = export.export_features(manifest, held, CONFIG, clips.random_encoder(4, 2, 8), width=8)
    assert features.count() > 0
