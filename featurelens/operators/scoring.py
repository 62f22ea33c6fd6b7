"""Prediction errors on gathered target tokens and their example-level means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.functions import vectors as vec


def gather_tokens(tokens: DataFrame, masks: DataFrame) -> DataFrame:
    """Tokens at the masked cells: equi-join on (sample, position)."""
    cells = masks.withColumnRenamed("cell", "pos")
    return cells.join(tokens, ["sample_id", "pos"])


def prediction_scores(pairs: DataFrame, exponent: float = 1.0, keys=("sample_id", "mask_group")) -> DataFrame:
    """Mean error and mean cosine of ``predicted`` against ``target`` per example."""
    scored = pairs.select(
        *keys,
        vec.prediction_error("predicted", "target", exponent).alias("error"),
        F.coalesce(vec.cosine("predicted", "target"), F.lit(0.0)).alias("cosine"),
    )
    return scored.groupBy(*keys).agg(
        F.avg("error").alias("loss"),
        F.avg("cosine").alias("cosine"),
        F.count(F.lit(1)).alias("tokens"),
    )


def example_means(losses: DataFrame, value: str = "loss", by=()) -> DataFrame:
    """Mean over examples of each example's mean over mask groups."""
    by = list(by)
    groups = losses.groupBy(*by, "sample_id", "mask_group").agg(F.avg(value).alias("_v"))
    examples = groups.groupBy(*by, "sample_id").agg(F.avg("_v").alias("_v"))
    return examples.groupBy(*by).agg(
        F.avg("_v").alias(f"mean_{value}"), F.count(F.lit(1)).alias("examples")
    )


def prefix_metrics(df: DataFrame, prefix: str, keep=()) -> DataFrame:
    """Rename every metric column with a prefix."""
    return df.select(
        *[F.col(c) if c in keep else F.col(c).alias(f"{prefix}_{c}") for c in df.columns]
    )
