"""Positions and prefix sums inside groups of any size.

A window function hands each group to one task, so a group holding a large part of
the table would not spread. These helpers first measure the groups. If none exceeds
``rows_per_slice`` an ordinary window is bounded and is used as it is. Otherwise the
oversized groups are cut into ordered slices, each slice is ranked on its own, and
the slice's offset (the weight of all slices before it) is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurelens.functions.hashing import draw_uniform
from featurelens.session import materialise

ROWS_PER_SLICE = 1_000_000
MAX_HOT_GROUPS = 50_000


def _oversized(df: DataFrame, group: list[str], rows_per_slice: int, bound: int | None):
    """``(hot rows, rows per slice)``; at most MAX_HOT_GROUPS rows reach the driver.

    Fewer than ``MAX_HOT_GROUPS`` groups can each hold more than a
    ``1 / MAX_HOT_GROUPS`` share of the table, which bounds the list.
    """
    if bound is not None and bound <= rows_per_slice:
        return None, rows_per_slice
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    top = sizes.agg(F.max("_rows").alias("largest"), F.sum("_rows").alias("rows")).first()
    if top["largest"] is None or top["largest"] <= rows_per_slice:
        return None, rows_per_slice
    limit = max(rows_per_slice, top["rows"] // MAX_HOT_GROUPS)
    return sizes.filter(F.col("_rows") > limit).collect(), limit


def _with_offsets(sliced, group, order, weights):
    """Add each slice's offset to the running weights inside the slice."""
    totals = (
        sliced.filter("_split")
        .groupBy(*group, "_slice")
        .agg(*[F.sum(w).alias(f"_w{i}") for i, w in enumerate(weights.values())])
    )
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_slice").alias("_s"),
        *[F.sum(f"_w{i}").over(earlier).alias(f"_o{i}") for i in range(len(weights))],
    )
    ranked = _plain(sliced, [*group, "_slice"], order, weights)
    match = F.col("_slice") == F.col("_s")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # At most two slice rows per slice-sized block of the table: bounded by _oversized.
    joined = ranked.join(F.broadcast(offsets), match, "left")
    for i, out in enumerate(weights):
        joined = joined.withColumn(
            out, (F.col(out) + F.coalesce(F.col(f"_o{i}"), F.lit(0))).cast("bigint")
        )
    return joined.select([c for c in ranked.columns if c not in ("_slice", "_split")])


def _plain(df, group, order, weights):
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return df.select(
        "*",
        *[
            F.coalesce(F.sum(w).over(before), F.lit(0)).cast("bigint").alias(out)
            for out, w in weights.items()
        ],
    )


def _grouped(df, group):
    if group:
        return df, list(group), []
    return df.withColumn("_all", F.lit(0)), ["_all"], ["_all"]


def seeded_index(
    df: DataFrame,
    group: list[str],
    key: Column,
    tie: list[str],
    out: str = "index",
    weights: dict[str, Column] | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
    bound: int | None = None,
) -> DataFrame:
    """0-based position of each row in seeded order inside its group.

    ``key`` is an md5 key, so equal-width ranges of it hold about equally many rows
    and serve as slices. ``weights`` names integer columns to sum over the preceding
    rows; without it the rows themselves are counted into ``out``. A caller that knows
    no group exceeds ``bound`` rows saves measuring the groups when that is small.
    """
    df, group, extra = _grouped(df, group)
    weights = weights or {out: F.lit(1)}
    keyed = df.withColumn("_key", key)
    order = ["_key", *tie]
    hot, limit = _oversized(df, group, rows_per_slice, bound)
    if not hot:
        return _plain(keyed, group, order, weights).drop("_key", *extra)
    schema = df.select(*group).schema
    rows = [tuple(r[g] for g in group) + (-(-r["_rows"] // limit),) for r in hot]
    names = [f"_h{i}" for i in range(len(group))]
    hot_table = df.sparkSession.createDataFrame(
        rows, ", ".join(
            f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema.fields)
        ) + ", _slices bigint",
    )
    match = F.lit(True)
    for name, g in zip(names, group):
        match = match & F.col(g).eqNullSafe(F.col(name))
    sliced = (
        keyed.join(F.broadcast(hot_table), match, "left")
        .withColumn("_split", F.col("_slices").isNotNull())
        .withColumn(
            "_slice",
            F.coalesce(
                F.floor(draw_uniform(F.col("_key")) * F.col("_slices")), F.lit(0)
            ).cast("bigint"),
        )
        .drop("_slices", *names)
    )
    return _with_offsets(sliced, group, order, weights).drop("_key", *extra)


def bottom_k(df: DataFrame, group: list[str], key: Column, tie: list[str], k: int, out: str = "draw") -> DataFrame:
    """The first ``k`` rows of each group in seeded order, numbered from 0 in ``out``.

    Every task first keeps its own ``k`` of each group (a limit below the shuffle, up to
    ``windowGroupLimitThreshold`` of the session), so at most tasks x groups x k rows move,
    and a group of any size is cut down where its rows are.
    """
    order = Window.partitionBy(*group).orderBy("_key", *tie)
    ranked = df.withColumn("_key", key).withColumn("_rank", F.row_number().over(order))
    kept = ranked.filter(F.col("_rank") <= k)
    return kept.withColumn(out, (F.col("_rank") - 1).cast("bigint")).drop("_key", "_rank")


def sorted_index(
    df: DataFrame,
    group: list[str],
    order: list,
    out: str = "index",
    weights: dict[str, Column] | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
    bound: int | None = None,
) -> DataFrame:
    """Like :func:`seeded_index` for an arbitrary total order.

    Oversized groups are cut by one range shuffle. Its slice numbers are written to
    the checkpoint folder, so a lost executor cannot change them between the two
    places that read them.
    """
    df, group, extra = _grouped(df, group)
    weights = weights or {out: F.lit(1)}
    hot, _ = _oversized(df, group, rows_per_slice, bound)
    if not hot:
        return _plain(df, group, order, weights).drop(*extra)
    # A range partition boundary cuts at most one group, so at most one split group per
    # boundary takes part in the offsets.
    cut = materialise(
        df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn(
            "_slice", F.spark_partition_id().cast("bigint")
        )
    )
    spans = cut.groupBy(*group).agg(F.min("_slice").alias("_lo"), F.max("_slice").alias("_hi"))
    split = spans.filter("_lo < _hi").select(
        *[F.col(g).alias(f"_h{i}") for i, g in enumerate(group)], F.lit(True).alias("_split")
    )
    match = F.lit(True)
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_h{i}"))
    sliced = cut.join(F.broadcast(split), match, "left").withColumn(
        "_split", F.coalesce("_split", F.lit(False))
    ).drop(*[f"_h{i}" for i in range(len(group))])
    return _with_offsets(sliced, group, order, weights).drop(*extra)


def average_ranks(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """1-based ranks with ties sharing their mean rank.

    Ties are counted first; the ranked table then has one row per distinct value, so a
    value repeated across the table is one row, not one task's load.
    """
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_ties"))
    below = sorted_index(counts, group, [F.col(value)], weights={"_below": F.col("_ties")})
    ranks = below.select(
        *group, value, (F.col("_below") + (F.col("_ties") + 1) / 2).alias(out)
    )
    return df.join(ranks, [*group, value])


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate: NaN where a side has no spread, null below two pairs.

    ``corr`` divides by the spread even where it is zero, which is an error in ANSI mode.
    """
    x, y = F.col(x), F.col(y)
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    pairs = F.count(F.when(both, 1))
    undefined = F.when(pairs > 1, F.lit(float("nan")))
    return F.when(spread == 0, undefined).otherwise(F.covar_pop(x, y) / spread)
