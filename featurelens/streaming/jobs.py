"""Streaming jobs over landing files: variance state, collapse monitor, running best.

Each job reads a folder as it fills, keeps mergeable statistics and can be stopped and
restarted on its checkpoint. Micro-batches write under their own batch number, so a
batch that runs twice replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from featurelens.functions import vectors as vec
from featurelens.operators.geometry_stats import shares, token_accumulators


def landing_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _by_batch(rows: DataFrame, path: str, checkpoint: str, mode: str, prepare) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def accumulate_tokens(tokens: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Store each micro-batch's clip and position sums below ``state``."""
    return _by_batch(tokens, state, checkpoint, "append", token_accumulators)


def merged_shares(spark: SparkSession, state: str) -> DataFrame:
    """Token variance shares from all stored sums."""
    parts = spark.read.parquet(state)
    merged = parts.groupBy("is_clip", "clip_id", "pos").agg(
        F.sum("tokens").alias("tokens"),
        vec.sums("total").alias("total"),
        F.sum("squares").alias("squares"),
    )
    return shares(merged)


def compact_state(spark: SparkSession, state: str, target: str) -> None:
    """Rewrite many batches of sums as one, into a new folder."""
    parts = spark.read.parquet(state)
    parts.groupBy("is_clip", "clip_id", "pos").agg(
        F.sum("tokens").alias("tokens"),
        vec.sums("total").alias("total"),
        F.sum("squares").alias("squares"),
    ).write.parquet(f"{target}/batch=0")


def collapse_windows(rows: DataFrame, time: str, width: str, delay: str) -> DataFrame:
    """Spread and between-clip share of the features that arrive in each time window.

    Works on a stream or a table. Sums per (window, clip) come first, so the second
    aggregation sees one row per clip.
    """
    timed = rows.withWatermark(time, delay)
    squares = F.transform("features", lambda x: x * x)
    by_clip = timed.groupBy(F.window(time, width), "clip_id").agg(
        F.count(F.lit(1)).alias("n"),
        vec.sums("features").alias("total"),
        vec.sums(squares).alias("squares"),
    )
    by_window = by_clip.groupBy(F.window(F.window_time("window"), width)).agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("clips"),
        vec.sums("total").alias("_s"),
        vec.sums("squares").alias("_q"),
        F.sum(vec.squared_norm("total") / F.col("n")).alias("_clip"),
    )
    n = F.col("rows")
    spread = F.zip_with("_q", "_s", lambda q, s: F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
    total = vec.total(spread)
    mu = vec.squared_norm("_s") / (n * n)
    return by_window.select(
        F.col("window.start").alias("window_start"),
        "rows",
        "clips",
        (vec.total(F.transform(spread, lambda v: F.sqrt(v))) / F.size("_s")).alias("feature_std"),
        F.when(total > 0, (F.col("_clip") / n - mu) / total).alias("beta"),
    )


def monitor_collapse(rows: DataFrame, time: str, width: str, delay: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append the statistics of every closed window to ``path``."""
    return (
        collapse_windows(rows, time, width, delay)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("parquet")
        .start(path)
    )


def track_best(metrics: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep each run's earliest lowest loss; store the runs a micro-batch changed."""
    real = metrics.filter(F.col("loss").isNotNull() & ~F.isnan("loss"))
    best = real.groupBy("run_id").agg(F.min(F.struct("loss", "epoch")).alias("best"))
    return _by_batch(best, path, checkpoint, "update", lambda batch: batch)


def current_best(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path).groupBy("run_id").agg(F.min("best").alias("b"))
    return rows.select("run_id", F.col("b.epoch").alias("best_epoch"), F.col("b.loss").alias("best_loss"))
