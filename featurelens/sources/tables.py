"""Manifests, feature tables, run histories and result reports on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelens.functions.hashing import draw_word
from featurelens.functions.ranking import sorted_index
from featurelens.functions.vectors import vector_width
from featurelens.schemas import HISTORY, MANIFEST_COLUMNS, METADATA_COLUMNS, PROBE_COLUMNS

FEATURE_PREFIX = "feature_"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("enforceSchema", False).csv(path)


def read_manifest(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """Manifest rows with ``frame_dir`` below ``root``; extra columns pass through.

    A missing column or an empty table is an error, and so is a frame count that is not
    an integer. Empty fields are empty strings.
    """
    raw = _csv(spark, path)
    absent = [c for c in MANIFEST_COLUMNS if c not in raw.columns]
    if absent:
        raise ValueError(f"{path} is no manifest: it has no {', '.join(absent)}")
    if raw.isEmpty():
        raise ValueError(f"{path} lists no recordings")
    filled = raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in raw.columns])
    rooted = F.concat_ws("/", F.lit(root.rstrip("/")), "frame_dir") if root else F.col("frame_dir")
    return filled.withColumn("frame_dir", rooted).withColumn(
        "num_frames", F.col("num_frames").cast("int")
    )


def write_manifest(df: DataFrame, path: str, form: str = "csv") -> None:
    """Fixed column order; ``parquet`` is partitioned by split for pruning."""
    rows = df.select(*MANIFEST_COLUMNS)
    if form == "csv":
        rows.write.option("header", True).option("emptyValue", "").csv(path)
    else:
        rows.write.partitionBy("split").parquet(path)


def feature_columns(columns: list[str]) -> list[str]:
    """Feature columns found by prefix, in numeric order."""
    found = [c for c in columns if c.startswith(FEATURE_PREFIX)]
    return sorted(found, key=lambda c: int(c[len(FEATURE_PREFIX) :]))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Wide feature CSV as metadata plus one ``features`` array."""
    raw = _csv(spark, path)
    names = feature_columns(raw.columns)
    if not names:
        raise ValueError(f"no {FEATURE_PREFIX} columns in {path}")
    meta = [
        F.col(c).cast("int").alias(c) if c == "window_start" else F.coalesce(c, F.lit("")).alias(c)
        for c in raw.columns
        if c not in names
    ]
    return raw.select(*meta, F.array(*[F.col(n).cast("float") for n in names]).alias("features"))


def write_features(df: DataFrame, path: str) -> None:
    width = vector_width(df)
    wide = [F.col("features")[i].cast("float").alias(f"{FEATURE_PREFIX}{i}") for i in range(width)]
    df.select(*METADATA_COLUMNS, *wide).write.option("header", True).csv(path)


def read_history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Run histories: one JSON list per file, or one object per line."""
    return spark.read.schema(HISTORY).option("multiLine", not lines).json(path)


def write_history(df: DataFrame, path: str) -> None:
    df.select(*HISTORY.names).write.json(path)


def write_probe_results(df: DataFrame, path: str) -> None:
    df.select(*PROBE_COLUMNS).write.option("header", True).csv(path)


def read_probe_results(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path)
    counts = {"train_examples", "val_examples", "num_classes"}
    texts = {"model", "task"}
    return raw.select(
        *[
            F.col(c) if c in texts else F.col(c).cast("bigint" if c in counts else "double")
            for c in PROBE_COLUMNS
        ]
    )


def write_report(df: DataFrame, path: str) -> None:
    """Statistics rows as JSON lines."""
    df.write.json(path)


def table_fingerprint(df: DataFrame, group=()) -> DataFrame:
    """Order-insensitive content hash: row count and the sum of row hash words.

    A row is hashed from the md5 of each column's text, by column name, so values of any
    length count whole. The sum of 60-bit words is a wide decimal and cannot overflow.
    Rows are added up per ``group``, if any.
    """
    group = list(group)
    cells = [
        F.concat(F.lit(f"{c}="), F.coalesce(F.md5(F.col(f"`{c}`").cast("string")), F.lit("null")))
        for c in sorted(set(df.columns) - set(group))
    ]
    word = draw_word(F.md5(F.concat_ws("|", *cells))).cast("decimal(38,0)")
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(word), F.lit(0)).cast("string").alias("fingerprint"),
    )


def append_results(df: DataFrame, path: str) -> None:
    """Add result rows to an append-only history table."""
    df.write.mode("append").parquet(path)


def classify_changes(history: DataFrame, task: str = "task", order: str = "run_no") -> DataFrame:
    """Whether each run differs from the one before in its model, its evaluation or both.

    ``history`` has ``feature_fingerprint`` and ``evaluation_fingerprint``. The earlier
    run arrives by an equi-join on its position.
    """
    placed = sorted_index(history, [task], [F.col(order)], out="_i")
    before = placed.select(
        task,
        (F.col("_i") + 1).alias("_i"),
        F.col("feature_fingerprint").alias("_f"),
        F.col("evaluation_fingerprint").alias("_e"),
    )
    model = ~F.col("feature_fingerprint").eqNullSafe(F.col("_f"))
    evaluation = ~F.col("evaluation_fingerprint").eqNullSafe(F.col("_e"))
    change = (
        F.when(F.col("_i") == 0, "first")
        .when(model & evaluation, "both")
        .when(model, "model")
        .when(evaluation, "evaluation")
        .otherwise("none")
    )
    return placed.join(before, [task, "_i"], "left").withColumn("change", change).drop("_i", "_f", "_e")
