"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the next aggregation then needs its own shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Shuffle files go when their query ends, not when the driver happens to collect garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Up to this many first rows of a group are kept apart by each task before they are moved.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "featurelens", master: str | None = None, **conf) -> SparkSession:
    """A session with the engine's defaults; keyword keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


_SHIPPED: set[str] = set()
_SCRATCH: list[str] = []
_TABLES: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(package):  # already runs from a shipped archive
        return
    name = os.path.basename(package)
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(package):
            inner = os.path.join(name, os.path.relpath(folder, package))
            for file in sorted(files):
                if file.endswith(".py"):
                    out.write(os.path.join(folder, file), os.path.normpath(os.path.join(inner, file)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def adapt(spark: SparkSession) -> SparkSession:
    """Ship the package and apply the settings that joins and large intermediates rely on."""
    ship(spark)
    for key, value in DEFAULTS.items():
        if key.startswith(("spark.sql.adaptive.", "spark.sql.classic.", "spark.sql.optimizer.")):
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` (or a checkpoint folder set on the context) wins; a
    temporary folder is made only for a local master that names none.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="featurelens-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back with its schema."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """``df`` stored in buckets of ``keys``, sorted by them, and read back as a table.

    One file per bucket: joins and aggregations by ``keys`` read it without an exchange, as
    often as they like. The table lies below the shared folder and goes with the session.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table = f"{name}_{path.rsplit('-', 1)[-1]}"
    writer = df.repartition(count, *keys).write.bucketBy(count, *keys).sortBy(*keys)
    writer.format("parquet").option("path", path).saveAsTable(table)
    _TABLES.append(table)
    return spark.table(table)


@atexit.register
def _drop_scratch() -> None:
    """Remove this process's scratch folders when it ends; a lost session leaves them."""
    spark = SparkSession.getActiveSession() if _SCRATCH else None
    try:
        if spark is None or spark.sparkContext._jsc is None:
            return
        for table in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in _SCRATCH:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may already be gone
        return


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
