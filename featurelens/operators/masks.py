"""Multi-block tube masks as seeded Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelens.functions import geometry as geo
from featurelens.functions.hashing import draw_below, draw_uniform, seeded_key
from featurelens.functions.vectors import let

# The default mask groups, the aspect-ratio range and the retry limit.
DEFAULT_GROUPS = (
    {"label": "small_blocks", "num_blocks": 8, "spatial_scale": 0.15},
    {"label": "large_blocks", "num_blocks": 2, "spatial_scale": 0.55},
)
ASPECT_RATIO = (0.75, 1.5)
ATTEMPTS = 256


def _block_cells(block, grid, key):
    """Cells of one seeded block placement."""
    height, width = block["height"], block["width"]
    corner = let(
        key,
        lambda k: F.struct(
            draw_below(k, F.lit(grid) - height + 1, 0).alias("t"),
            draw_below(k, F.lit(grid) - width + 1, 1).alias("l"),
        ),
    )
    return let(
        corner,
        lambda at: F.flatten(
            F.transform(
                F.sequence(at["t"], at["t"] + height - 1),
                lambda r: F.transform(
                    F.sequence(at["l"], at["l"] + width - 1), lambda c: r * F.lit(grid) + c
                ),
            )
        ),
    )


def _target(block, group, number, grid, least_context, seed):
    """The first attempt whose block union leaves enough context."""
    def union(attempt):
        blocks = F.transform(
            F.sequence(F.lit(0), F.lit(group["num_blocks"] - 1)),
            lambda b: _block_cells(
                block, grid, seeded_key(seed, F.lit(number), F.col("sample_id"), attempt, b)
            ),
        )
        return F.sort_array(F.array_distinct(F.flatten(blocks)))

    none = F.lit(None).cast("array<bigint>")
    fits = lambda cells: F.when(F.lit(grid * grid) - F.size(cells) >= least_context, cells)
    found = F.aggregate(
        F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)),
        none,
        lambda acc, attempt: F.when(acc.isNotNull(), acc).otherwise(let(union(attempt), fits)),
    )
    refused = F.raise_error(F.lit(f"no mask of {group['label']} leaves {least_context} context cells"))
    return F.coalesce(found, refused.cast("array<bigint>"))


def _keep(cells, count, role, seed):
    """``count`` seeded cells, in rising order."""
    ordered = F.sort_array(
        F.transform(
            cells,
            lambda c: F.struct(
                seeded_key(seed, F.col("mask_group"), F.col("sample_id"), F.lit(role), c).alias("k"),
                c.alias("c"),
            ),
        )
    )
    return F.sort_array(F.transform(F.slice(ordered, F.lit(1), count), lambda s: s["c"]))


def _drawn(samples, grid, steps, min_context_tokens, groups, seed):
    """One row per sample and mask group with the untrimmed target cells.

    Samples are spread by batch before the draws, which cost far more than the rows; the
    per-batch trimming later reuses that partitioning.
    """
    least = max(1, math.ceil(min_context_tokens / steps))
    low, high = ASPECT_RATIO
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = []
    for number, group in enumerate(groups):
        key = seeded_key(seed, F.lit(number), F.col("batch"))
        aspect = F.lit(low) + F.lit(high - low) * draw_uniform(key)
        block = geo.block_size(grid, group["spatial_scale"], aspect)
        target = let(block, lambda b: _target(b, group, number, grid, least, seed))
        drawn.append(
            F.struct(
                F.lit(number).alias("mask_group"), F.lit(group["label"]).alias("label"), target.alias("target")
            )
        )
    spread = samples.select("sample_id", "batch").repartition(parts, "batch")
    return spread.select("sample_id", "batch", F.inline(F.array(*drawn)))


def mask_targets(
    samples: DataFrame, grid: int, steps: int, min_context_tokens: int = 1, groups=DEFAULT_GROUPS, seed: int = 0
) -> DataFrame:
    """Spatial target cells before trimming, one row each."""
    drawn = _drawn(samples, grid, steps, min_context_tokens, groups, seed)
    return drawn.select("sample_id", "mask_group", F.explode("target").alias("cell"))


def sample_masks(
    samples: DataFrame, grid: int, steps: int, min_context_tokens: int = 1, groups=DEFAULT_GROUPS, seed: int = 0
) -> DataFrame:
    """Disjoint context and target tokens per sample and mask group.

    ``samples`` has ``sample_id`` and ``batch``. A group's block shape is drawn once per
    batch, its target is a union of blocks, and both sides are trimmed to the smallest
    of the batch before they are repeated over the time steps.
    """
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(grid * grid - 1).cast("bigint"))
    drawn = _drawn(samples, grid, steps, min_context_tokens, groups, seed)
    # A batch is a fixed number of samples.
    batch = Window.partitionBy("batch", "mask_group")
    sized = drawn.withColumn("context", F.array_except(every, F.col("target"))).select(
        "*",
        F.min(F.size("target")).over(batch).alias("_t"),
        F.min(F.size("context")).over(batch).alias("_c"),
    )
    return sized.select(
        "sample_id",
        "batch",
        "mask_group",
        "label",
        geo.tube_tokens(_keep(F.col("context"), F.col("_c"), "ctx", seed), steps, grid).alias("ctx"),
        geo.tube_tokens(_keep(F.col("target"), F.col("_t"), "pred", seed), steps, grid).alias("pred"),
    )


def mask_cells(masks: DataFrame) -> DataFrame:
    """Long form: one row per (sample, group, role, cell)."""
    roles = F.array(
        F.struct(F.lit("ctx").alias("role"), F.col("ctx").alias("cells")),
        F.struct(F.lit("pred").alias("role"), F.col("pred").alias("cells")),
    )
    rows = masks.select("sample_id", "batch", "mask_group", "label", F.inline(roles))
    return rows.select(
        "sample_id", "batch", "mask_group", "label", "role", F.explode("cells").alias("cell")
    )


def context_complement(targets: DataFrame, cells: DataFrame) -> DataFrame:
    """All cells of a sample and group that are not targets.

    Both sides have rows per sample, whatever size is guessed for exploded ones, so they
    meet by a shuffle and never as a broadcast.
    """
    keys = ["sample_id", "mask_group", "cell"]
    return cells.join(targets.select(*keys).hint("merge"), keys, "left_anti")


def mask_audit(masks: DataFrame) -> DataFrame:
    """Per group: samples, overlapping cells, and whether every batch is rectangular."""
    overlap = F.size(F.array_intersect("ctx", "pred"))
    by_batch = masks.groupBy("mask_group", "label", "batch").agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum(overlap).alias("overlap"),
        *[F.min(F.size(c)).alias(f"min_{c}") for c in ("ctx", "pred")],
        *[F.max(F.size(c)).alias(f"max_{c}") for c in ("ctx", "pred")],
    )
    ragged = (F.col("min_ctx") != F.col("max_ctx")) | (F.col("min_pred") != F.col("max_pred"))
    return by_batch.groupBy("mask_group", "label").agg(
        F.sum("samples").alias("samples"),
        F.sum("overlap").alias("overlapping_cells"),
        F.sum(ragged.cast("int")).alias("ragged_batches"),
    )
