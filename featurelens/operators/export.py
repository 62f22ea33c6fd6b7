"""Feature export: manifest and frames to pooled clip features under one config."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.config import ClipConfig
from featurelens.operators import clips
from featurelens.operators.windows import augment_crops, eval_windows, train_windows, window_frames
from featurelens.session import bucketed

KEYS = ["recording_id", "window_index"]


def hold_frames(frames: DataFrame, config: ClipConfig, buckets: int | None = None) -> DataFrame:
    """Decoded frames with their foreground boxes, bucketed by (recording, frame).

    Written once for all epochs and splits: windows are bucketed alike when they meet the
    frames, so pixels are never moved again.
    """
    pixels = frames.select("recording_id", "frame_no", "height", "width", "pixels")
    boxed = clips.frame_boxes(pixels, config.foreground_threshold, keep_pixels=True)
    return bucketed(boxed, ["recording_id", "frame_no"], "frames", buckets)


def export_clips(
    manifest: DataFrame, frames: DataFrame, config: ClipConfig, epoch: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(windows, rendered frames)`` of the usable recordings.

    ``frames`` has recording_id, frame_no and pixels, or is a table of ``hold_frames``, into
    which it is made first otherwise. Counts, windows and crops are made
    from narrow columns, and pixels are only read for frames that a window covers. Frame
    counts come from the frames themselves, not from the manifest. Given an ``epoch``, each
    recording has one seeded training window with a drawn crop scale and flip.
    """
    held = frames if "box" in frames.columns else hold_frames(frames, config)
    sizes = held.groupBy("recording_id").agg(F.count(F.lit(1)).alias("num_frames"))
    counted = manifest.drop("num_frames").join(sizes, "recording_id")
    if epoch is None:
        windows = eval_windows(counted, config.num_frames, config.windows)
    else:
        windows = train_windows(counted, config.num_frames, epoch, config.seed).withColumn("window_index", F.lit(0))
    starts = windows.select(*KEYS, "window_start")
    covered = window_frames(starts, held.drop("pixels"), config.num_frames).drop("window_start")
    crops = clips.window_boxes(covered, KEYS, config.foreground_margin).select(*KEYS, "width", "height", "crop")
    if not config.foreground_crop:
        crops = crops.withColumn("crop", F.lit(None).cast(crops.schema["crop"].dataType))
    if epoch is None:
        crops = crops.withColumn("flip", F.lit(False))
    else:
        crops = augment_crops(
            crops.withColumnRenamed("crop", "box"), epoch, config.seed, config.crop_scale, config.flip_probability
        )
    placed = covered.select(*KEYS, "frame_no", "clip_offset").join(crops.select(*KEYS, "crop", "flip"), KEYS)
    # The frames' buckets are the partitions of this join; only the narrow side is moved.
    ready = placed.join(held.drop("box"), ["recording_id", "frame_no"]).select(
        *KEYS, "clip_offset", "height", "width", "pixels", "crop", "flip"
    )
    return windows, clips.materialise_clips(ready, config.img_size, config.foreground_crop)


def export_features(
    manifest: DataFrame,
    frames: DataFrame,
    config: ClipConfig,
    make_encoder: Callable[[], Callable],
    width: int,
    splits=("train", "test"),
) -> DataFrame:
    """Metadata plus one pooled vector per window of the chosen splits."""
    chosen = manifest.filter(F.col("split").isin(*splits))
    windows, rendered = export_clips(chosen, frames, config)
    scored = clips.score_clips(
        rendered, KEYS, config.img_size, make_encoder, width, config.input_mean, config.input_std
    )
    return windows.join(scored, KEYS)


def export_tokens(manifest: DataFrame, frames: DataFrame, config: ClipConfig) -> DataFrame:
    """Patch tokens ``clip_id, pos, features`` of every window."""
    _, rendered = export_clips(manifest, frames, config)
    tokens = clips.patchify(rendered, KEYS, config.img_size, config.patch_size, config.tubelet_size)
    return tokens.select(
        F.concat_ws("#", "recording_id", F.col("window_index").cast("string")).alias("clip_id"),
        "pos",
        "features",
    )
