"""Per-recording signal baselines: spectrum, autocorrelation and self-similarity.

Signals are cut into chunks of consecutive frames; a chunk carries the first frames of the
next one as a halo, so every pair of frames at a short lag stands in one chunk. Each frame
is moved once (those of a halo twice), whatever the number of bins or lags, and a recording
of any length spreads over its chunks. What chunks yield are mergeable sums.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.functions import vectors as vec
from featurelens.functions.ranking import correlation

#: Frames of a chunk, without its halo.
CHUNK = 512


def chunks(frames: DataFrame, value: str, halo: int, recording: str = "recording_id", size: int | None = None) -> DataFrame:
    """``recording, chunk, signal``: frames ``(f, v, own)`` in order; ``own`` is false in the halo.

    Frame numbers are unique within a recording and may have gaps.
    """
    size = max(size or CHUNK, halo, 1)
    at = F.floor(F.col("frame_no") / size)
    inside = F.col("frame_no") - at * size
    homes = F.when(inside < halo, F.array(at, at - 1)).otherwise(F.array(at))
    placed = frames.select(
        recording, F.explode(homes).alias("chunk"), at.alias("_own"), F.col("frame_no").alias("f"), F.col(value).alias("v")
    )
    frame = F.struct("f", "v", (F.col("chunk") == F.col("_own")).alias("own"))
    return placed.groupBy(recording, "chunk").agg(F.array_sort(F.collect_list(frame)).alias("signal"))


def _pairs(frames: DataFrame, value: str, lags: int, recording: str) -> DataFrame:
    """``recording, f, v, lag, later``: every frame of a chunk with those after it."""
    held = chunks(frames, value, lags, recording)
    each = held.select(recording, "signal", F.posexplode("signal").alias("_at", "_frame")).filter("_frame.own")
    after = F.slice("signal", F.col("_at") + 2, F.lit(lags))
    near = F.filter(after, lambda s: s["f"] - F.col("_frame.f") <= lags)
    paired = each.select(recording, F.col("_frame.f").alias("f"), F.col("_frame.v").alias("v"), F.explode(near).alias("_later"))
    return paired.select(
        recording, "f", "v", (F.col("_later.f") - F.col("f")).cast("int").alias("lag"), F.col("_later.v").alias("later")
    )


def spectrum(frames: DataFrame, value: str, bins: int, recording: str = "recording_id") -> DataFrame:
    """Power of the first ``bins`` Fourier coefficients of each recording's signal."""
    held = chunks(frames, value, 0, recording)
    sizes = held.groupBy(recording).agg(F.sum(F.size("signal")).alias("_n"))

    def sums(b):
        angle = lambda s: F.lit(2 * math.pi) * b * s["f"] / F.col("_n")
        part = lambda wave: F.aggregate("signal", F.lit(0.0), lambda acc, s: acc + F.coalesce(s["v"] * wave(angle(s)), F.lit(0.0)))
        return F.struct(b.alias("bin"), part(F.cos).alias("_re"), part(F.sin).alias("_im"))

    partial = held.join(sizes, recording).select(
        recording, F.size("signal").alias("_frames"), F.inline(F.transform(F.sequence(F.lit(1), F.lit(bins)), sums))
    )
    whole = partial.groupBy(recording, "bin").agg(
        F.sum("_re").alias("_re"), F.sum("_im").alias("_im"), F.sum("_frames").cast("bigint").alias("frames")
    )
    return whole.select(
        recording,
        "bin",
        "frames",
        ((F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")) / F.col("frames")).alias("power"),
    )


def lag_statistics(frames: DataFrame, value: str, lags: int, recording: str = "recording_id") -> DataFrame:
    """Autocorrelation and mean absolute change of each recording at every lag."""
    return _pairs(frames, value, lags, recording).groupBy(recording, "lag").agg(
        F.count(F.lit(1)).alias("pairs"),
        correlation("v", "later").alias("autocorrelation"),
        F.avg(F.abs(F.col("later") - F.col("v"))).alias("mean_change"),
    )


def self_similarity(frames: DataFrame, features: str, band: int, recording: str = "recording_id") -> DataFrame:
    """Band of each recording's self-similarity matrix: cosine of frames ``lag`` apart.

    One row per frame and lag, ``1 .. band``; null where a vector is zero.
    """
    vectors = frames.select(recording, "frame_no", vec.as_doubles(features).alias("_x"))
    paired = _pairs(vectors, "_x", band, recording)
    return paired.select(recording, F.col("f").alias("frame_no"), "lag", vec.cosine("v", "later").alias("similarity"))


def similarity_profile(similar: DataFrame, recording: str = "recording_id") -> DataFrame:
    """Mean and spread of the band of each recording at every lag."""
    return similar.groupBy(recording, "lag").agg(
        F.count("similarity").alias("pairs"),
        F.avg("similarity").alias("mean_similarity"),
        F.stddev_pop("similarity").alias("spread"),
    )


def period_estimate(lag_rows: DataFrame, min_pairs: int = 3, recording: str = "recording_id") -> DataFrame:
    """The lag of strongest autocorrelation per recording; ties go to the shortest."""
    usable = lag_rows.filter(
        (F.col("pairs") >= min_pairs) & F.col("autocorrelation").isNotNull()
    ).filter(~F.isnan("autocorrelation"))
    best = F.min(F.struct((-F.round("autocorrelation", 9)).alias("c"), F.col("lag").alias("lag")))
    return usable.groupBy(recording).agg(best["lag"].cast("bigint").alias("period"))
