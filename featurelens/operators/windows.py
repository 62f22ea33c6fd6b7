"""Clip windows, seeded epoch order and the frames a window covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.functions.geometry import recrop
from featurelens.functions.hashing import draw_below, draw_uniform, seeded_key
from featurelens.functions.ranking import seeded_index


def eval_windows(df: DataFrame, clip_length: int, windows: int = 1) -> DataFrame:
    """``windows`` evenly spaced starts per recording; a single window is centred."""
    usable = df.filter(F.col("num_frames") >= clip_length)
    last = F.col("num_frames") - clip_length
    numbered = usable.withColumn(
        "window_index", F.explode(F.sequence(F.lit(0), F.lit(windows - 1)))
    )
    if windows == 1:
        start = F.floor(last / 2)
    else:
        start = F.rint(F.col("window_index") * last / F.lit(windows - 1))
    return numbered.withColumn("window_start", start.cast("bigint"))


def train_windows(
    df: DataFrame, clip_length: int, epoch: int, seed: int = 0, id_column: str = "recording_id"
) -> DataFrame:
    """One seeded start per recording and epoch."""
    usable = df.filter(F.col("num_frames") >= clip_length)
    key = seeded_key(seed, F.lit(epoch), F.col(id_column))
    return usable.withColumn("epoch", F.lit(epoch)).withColumn(
        "window_start", draw_below(key, F.col("num_frames") - clip_length + 1)
    )


def augment_crops(
    df: DataFrame,
    epoch: int,
    seed: int = 0,
    scale_range: tuple[float, float] = (1.0, 1.0),
    flip_probability: float = 0.0,
    id_column: str = "recording_id",
) -> DataFrame:
    """Seeded crop scale, crop box and flip for each clip.

    Needs ``width``, ``height`` and a nullable foreground box ``box`` (struct of left,
    top, right, bottom). A clip without a box gets a random crop of the frame.
    """
    low, high = scale_range
    key = F.col("_key")
    scale = F.lit(low) + draw_uniform(key, 1) * F.lit(high - low)
    drawn = df.withColumn("_key", seeded_key(seed, F.lit(epoch), F.col(id_column)))
    drawn = drawn.withColumn("scale", scale)
    crop_w = F.rint(F.col("width") * F.col("scale")).cast("bigint")
    crop_h = F.rint(F.col("height") * F.col("scale")).cast("bigint")
    left = draw_below(key, F.col("width") - crop_w + 1, 2)
    top = draw_below(key, F.col("height") - crop_h + 1, 3)
    free = F.struct(
        left.alias("left"),
        top.alias("top"),
        (left + crop_w).alias("right"),
        (top + crop_h).alias("bottom"),
    )
    centred = recrop(F.col("box"), F.col("scale"), F.col("width"), F.col("height"))
    flip_key = seeded_key(seed, F.lit(epoch), F.col(id_column), F.lit("flip"))
    return drawn.withColumn(
        "crop",
        F.when(F.col("box").isNull(), free)
        .when(F.col("scale") == 1.0, F.col("box"))
        .otherwise(centred),
    ).withColumn("flip", draw_uniform(flip_key) < F.lit(flip_probability)).drop("_key")


def epoch_batches(
    df: DataFrame,
    batch_size: int,
    epoch: int,
    seed: int = 0,
    id_column: str = "recording_id",
    drop_last: bool = True,
) -> DataFrame:
    """Seeded epoch order cut into batches; ``batch`` and ``slot`` are 0-based."""
    key = seeded_key(seed, F.lit(epoch), F.col(id_column))
    rows = df.count()
    ranked = seeded_index(df, [], key, [id_column], out="_order", bound=rows)
    batched = ranked.withColumn("batch", F.floor(F.col("_order") / batch_size)).withColumn(
        "slot", F.col("_order") % batch_size
    )
    if drop_last:
        batched = batched.filter(F.col("batch") < rows // batch_size)
    return batched.drop("_order")


def accumulation_sizes(batches: DataFrame, n_batches: int, steps: int) -> DataFrame:
    """How many batches share each batch's optimiser update."""
    if steps < 1:
        raise ValueError("accumulation needs at least one step")
    first = F.floor(F.col("batch") / steps) * steps
    return batches.withColumn(
        "accumulation_size", F.least(F.lit(steps).cast("bigint"), F.lit(n_batches) - first)
    )


def window_frames(windows: DataFrame, frames: DataFrame, clip_length: int) -> DataFrame:
    """Frames ``window_start .. window_start + clip_length - 1`` of each window.

    The range condition becomes an equi-join on (recording, block of ``clip_length``
    frames): a window touches at most two blocks, so a recording of any length spreads
    over its blocks instead of meeting in one task.
    """
    first = F.floor(F.col("window_start") / clip_length)
    final = F.floor((F.col("window_start") + clip_length - 1) / clip_length)
    left = windows.withColumn("_block", F.explode(F.sequence(first, final)))
    right = frames.withColumn("_block", F.floor(F.col("frame_no") / clip_length))
    joined = left.join(right, ["recording_id", "_block"])
    offset = F.col("frame_no") - F.col("window_start")
    return (
        joined.filter((offset >= 0) & (offset < clip_length))
        .withColumn("clip_offset", offset.cast("int"))
        .drop("_block")
    )


def contact_sheet(df: DataFrame, shown: int = 8) -> DataFrame:
    """Evenly spaced frame numbers, truncated to integers, of each recording."""
    n = F.col("num_frames")
    m = F.least(F.lit(shown).cast("bigint"), n.cast("bigint"))
    slots = df.filter(n > 0).withColumn("_m", m).withColumn(
        "slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1))
    )
    step = (n - 1) / F.greatest(F.col("_m") - 1, F.lit(1))
    frame = F.when(
        (F.col("slot") == F.col("_m") - 1) & (F.col("slot") > 0), (n - 1).cast("bigint")
    ).otherwise(F.floor(F.col("slot") * step))
    return slots.withColumn("frame_no", frame).drop("_m")
