"""Range-ordered tables and running sums over them, for operators that number rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurelens.session import stored

#: Columns the helpers add; callers' columns must not begin with this.
PART = "__part"


def ranged(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` stored in range partitions of ``keys``, each row with its partition number.

    A row number breaks ties, so rows with one key spread over partitions; the stored
    numbers are what later reads see, however often they run.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn(f"{PART}_tie", F.monotonically_increasing_id())
    spread = tied.repartitionByRange(parts, *keys, F.col(f"{PART}_tie"))
    return stored(spread.withColumn(PART, F.spark_partition_id()).drop(f"{PART}_tie"), name)


def offsets(df: DataFrame, sums: dict[str, str], group: list[str] | None = None) -> DataFrame:
    """Per (group, partition): what the partitions before it add up to, and group totals.

    ``sums`` maps a new name to the column it adds; ``<name>_before`` and ``<name>_all``
    result. The table has one row for each partition that a group touches.
    """
    group = group or []
    totals = df.groupBy(*group, PART).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    order = Window.partitionBy(*group).orderBy(PART)
    everything = Window.partitionBy(*group)
    return totals.select(
        *group,
        PART,
        *((F.sum(n).over(order) - F.col(n)).alias(f"{n}_before") for n in sums),
        *(F.sum(n).over(everything).alias(f"{n}_all") for n in sums),
    )
