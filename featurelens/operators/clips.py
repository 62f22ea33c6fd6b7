"""From pixel frames to foreground boxes, resized clips, patch tokens and features."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurelens.functions import geometry as geo
from featurelens.functions import vectors as vec


def frame_boxes(frames: DataFrame, threshold: int = 8, keep_pixels: bool = False) -> DataFrame:
    """Add ``box`` of the pixels strictly above ``threshold``; null for a blank frame.

    Pixels are dropped unless they are to be kept.
    """
    def find(batches):
        for batch in batches:
            boxes = []
            for height, width, pixels in zip(batch["height"], batch["width"], batch["pixels"]):
                lit = np.frombuffer(pixels, np.uint8).reshape(height, width) > threshold
                rows, columns = np.flatnonzero(lit.any(axis=1)), np.flatnonzero(lit.any(axis=0))
                boxes.append(
                    (columns[0], rows[0], columns[-1] + 1, rows[-1] + 1) if len(rows) else (None,) * 4
                )
            sides = pd.DataFrame(boxes, columns=["left", "top", "right", "bottom"], dtype="Int64")
            kept = batch[[f.name for f in keep]].reset_index(drop=True)
            yield pd.concat([kept, sides], axis=1)

    keep = [f for f in frames.schema.fields if keep_pixels or f.name != "pixels"]
    schema = T.StructType(
        keep + [T.StructField(c, T.LongType()) for c in ("left", "top", "right", "bottom")]
    )
    read = frames if keep_pixels else frames.select(*[f.name for f in keep], "pixels")
    found = read.mapInPandas(find, schema)
    box = F.when(F.col("left").isNotNull(), geo.box(*[F.col(c) for c in ("left", "top", "right", "bottom")]))
    return found.withColumn("box", box).drop("left", "top", "right", "bottom")


def window_boxes(window_frames: DataFrame, keys: list[str], margin: float = 0.15) -> DataFrame:
    """Union box of a window's frames with a margin, clamped to the first frame.

    Blank frames have null sides, which minima and maxima skip; an all-blank window
    gets no box.
    """
    union = window_frames.groupBy(*keys).agg(
        F.min("box.left").alias("_l"),
        F.min("box.top").alias("_t"),
        F.max("box.right").alias("_r"),
        F.max("box.bottom").alias("_b"),
        F.min(F.struct("clip_offset", "width", "height")).alias("_first"),
    )
    bounds = F.when(F.col("_l").isNotNull(), geo.box(*[F.col(c) for c in ("_l", "_t", "_r", "_b")]))
    return union.select(
        *keys,
        bounds.alias("box"),
        F.col("_first.width").alias("width"),
        F.col("_first.height").alias("height"),
    ).withColumn("crop", geo.add_margin(F.col("box"), margin, F.col("width"), F.col("height")))


def _resample(size_in: int, size_out: int) -> np.ndarray:
    """Weights of a triangle filter that widens when shrinking."""
    scale = size_in / size_out
    reach = max(scale, 1.0)
    centre = (np.arange(size_out)[:, None] + 0.5) * scale
    distance = np.abs(np.arange(size_in)[None, :] + 0.5 - centre) / reach
    weights = np.maximum(1.0 - distance, 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def _cut(image: np.ndarray, crop) -> np.ndarray:
    """Crop; parts outside the image are black."""
    left, top, right, bottom = crop
    out = np.zeros((bottom - top, right - left), np.uint8)
    y0, y1 = max(top, 0), min(bottom, image.shape[0])
    x0, x1 = max(left, 0), min(right, image.shape[1])
    if y1 > y0 and x1 > x0:
        out[y0 - top : y1 - top, x0 - left : x1 - left] = image[y0:y1, x0:x1]
    return out


def materialise_clips(clip_frames: DataFrame, size: int, contain: bool = True) -> DataFrame:
    """Crop, flip and resize every frame of every window to ``size`` x ``size``.

    ``clip_frames`` has pixel columns and the clip's ``crop`` (nullable) and ``flip``.
    Frames are independent, so this is a map; output size and offsets come from Column
    arithmetic and only the pixels are handled in the batch.
    """
    box = F.coalesce("crop", geo.box(F.lit(0), F.lit(0), F.col("width"), F.col("height")))
    placed = clip_frames.withColumn("_box", box)
    w, h = F.col("_box.right") - F.col("_box.left"), F.col("_box.bottom") - F.col("_box.top")
    placed = placed.withColumn("_to", geo.letterbox(w, h, size, contain))
    work = placed.select(
        *[c for c in clip_frames.columns if c not in ("crop", "flip", "height", "width", "pixels")],
        "height", "width", "pixels", F.coalesce("flip", F.lit(False)).alias("flip"), "_box.*", "_to.*",
    )
    keep = [f for f in work.schema.fields[: len(clip_frames.columns) - 5]]

    def render(batches):
        filters = {}
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                image = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width)
                image = _cut(image, (r.left, r.top, r.right, r.bottom))
                if r.flip:
                    image = image[:, ::-1]
                for axis, target in ((1, r.out_w), (0, r.out_h)):
                    key = (image.shape[axis], target)
                    if key[0] != target:
                        if key not in filters:
                            filters[key] = _resample(*key)
                        mixed = filters[key] @ image if axis == 0 else image @ filters[key].T
                        image = np.clip(np.floor(mixed + 0.5), 0, 255).astype(np.uint8)
                canvas = np.zeros((size, size), np.uint8)
                canvas[r.off_y : r.off_y + r.out_h, r.off_x : r.off_x + r.out_w] = image
                out.append(canvas.tobytes())
            yield batch[[f.name for f in keep]].assign(pixels=out)

    return work.mapInPandas(render, T.StructType(keep + [T.StructField("pixels", T.BinaryType())]))


def patchify(clips: DataFrame, keys: list[str], size: int, patch: int, tubelet: int) -> DataFrame:
    """Non-overlapping tubelet x patch x patch tokens, row-major over (time, row, column).

    A frame is cut where it is; the frames of one tubelet are joined by a grouping that
    never holds more than ``tubelet`` rows.
    """
    if size % patch:
        raise ValueError("the patch size must divide the frame size")
    grid = size // patch

    def cut(batches):
        for batch in batches:
            frames = np.stack([np.frombuffer(p, np.uint8) for p in batch["pixels"]])
            blocks = frames.reshape(-1, grid, patch, grid, patch).swapaxes(2, 3)
            blocks = blocks.reshape(len(batch) * grid * grid, patch * patch) / 255.0
            out = batch[[*keys, "clip_offset"]].loc[batch.index.repeat(grid * grid)]
            yield out.assign(cell=np.tile(np.arange(grid * grid), len(batch)), part=list(blocks))

    schema = T.StructType(
        [clips.schema[k] for k in keys]
        + [clips.schema["clip_offset"], T.StructField("cell", T.LongType())]
        + [T.StructField("part", T.ArrayType(T.DoubleType()))]
    )
    parts = clips.select(*keys, "clip_offset", "pixels").mapInPandas(cut, schema)
    step = F.floor(F.col("clip_offset") / tubelet)
    gathered = parts.groupBy(*keys, (step * grid * grid + F.col("cell")).alias("pos")).agg(
        F.sort_array(F.collect_list(F.struct("clip_offset", "part"))).alias("_p")
    )
    return gathered.select(*keys, "pos", F.flatten(F.col("_p.part")).alias("features"))


def foreground_share(tokens: DataFrame, keys: list[str], level: float = 0.05) -> DataFrame:
    """Per clip: share of pixels above ``level`` and share of patches holding any."""
    lit = F.size(F.filter("features", lambda x: x > level))
    return tokens.groupBy(*keys).agg(
        (F.sum(lit) / F.sum(F.size("features"))).alias("pixel_share"),
        F.avg((lit > 0).cast("double")).alias("patch_share"),
    )


def score_clips(
    clips: DataFrame, keys: list[str], size: int, make_encoder: Callable[[], Callable],
    width: int, mean: float = 0.5, std: float = 0.5,
) -> DataFrame:
    """Run a frozen encoder over every clip and mean-pool its tokens.

    ``make_encoder()`` runs once per task and returns a callable from normalised video
    [batch, time, 1, size, size] to tokens [batch, tokens, width]. A clip is one row of
    its own few frames before it reaches Python.
    """
    packed = clips.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("clip_offset", "pixels"))).alias("_f")
    ).select(*keys, F.col("_f.pixels").alias("frames"))
    schema = T.StructType(
        [packed.schema[k] for k in keys] + [T.StructField("features", T.ArrayType(T.FloatType()))]
    )

    def score(batches):
        encode = make_encoder()
        for batch in batches:
            videos = [
                np.stack([np.frombuffer(p, np.uint8).reshape(1, size, size) for p in frames])
                for frames in batch["frames"]
            ]
            lengths = np.array([len(v) for v in videos])
            pooled = np.empty((len(batch), width), np.float32)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                video = np.stack([videos[i] for i in at]).astype(np.float32) / 255.0
                pooled[at] = encode((video - mean) / std).mean(axis=1)
            yield batch[keys].assign(features=list(pooled))

    return packed.mapInPandas(score, schema)


def random_encoder(patch: int, tubelet: int, width: int, seed: int = 0):
    """Factory of an untrained encoder: a seeded Gaussian projection of patch tokens."""
    def make():
        weights = np.random.default_rng(seed).normal(
            0.0, 0.02, (tubelet * patch * patch, width)
        ).astype(np.float32)

        def encode(video):
            batch, time, _, size, _ = video.shape
            grid = size // patch
            cut = video.reshape(batch, time // tubelet, tubelet, grid, patch, grid, patch)
            cut = cut.transpose(0, 1, 3, 5, 2, 4, 6).reshape(batch, -1, tubelet * patch * patch)
            return cut @ weights

        return encode

    return make


def project_features(df: DataFrame, width_in: int, width_out: int, seed: int = 0) -> DataFrame:
    """Random control of a feature table: a seeded Gaussian projection of its vectors."""
    weights = np.random.default_rng(seed).normal(0.0, 0.02, (width_out, width_in))
    rows = F.array(*[vec.literal(w) for w in weights])
    return df.withColumn("features", F.transform(rows, lambda w: vec.dot("features", w)))
