"""Loss audits, paired statistics, resampling and rank association."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelens.functions.hashing import draw_below, seeded_key
from featurelens.functions.ranking import average_ranks, correlation, seeded_index, sorted_index
from featurelens.operators import monotone
from featurelens.session import adapt, materialise


def condition_columns(losses: DataFrame, keys: list[str], conditions: list[str], value="loss") -> DataFrame:
    """One row per unit with the mean value under every condition (null when absent)."""
    return losses.filter(F.col("condition").isin(conditions)).groupBy(*keys).agg(
        *[F.avg(F.when(F.col("condition") == c, F.col(value))).alias(c) for c in conditions]
    )


def context_delta(losses: DataFrame, true: str, blank: str) -> DataFrame:
    """Mean over examples of (blank - true) loss, averaged over mask groups first."""
    paired = condition_columns(losses, ["sample_id", "mask_group"], [true, blank])
    deltas = paired.select("sample_id", (F.col(blank) - F.col(true)).alias("delta")).dropna()
    examples = deltas.groupBy("sample_id").agg(F.avg("delta").alias("delta"))
    return examples.agg(F.avg("delta").alias("blank_delta"), F.count(F.lit(1)).alias("examples"))


def substitution_ladder(losses: DataFrame, true: str, others: list[str]) -> DataFrame:
    """Gap of every substituted context to the true one, and its share of the true loss."""
    wide = condition_columns(losses, ["sample_id", "mask_group"], [true, *others])
    rows = wide.filter(F.col(true).isNotNull()).select(
        F.col(true).alias("_true"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("condition"), (F.col(c) - F.col(true)).alias("gap"))
                    for c in [true, *others]
                ]
            )
        ),
    )
    return (
        rows.filter(F.col("gap").isNotNull())
        .groupBy("condition")
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.avg("gap").alias("mean_gap"),
            F.avg("_true").alias("mean_loss"),
        )
        .withColumn("percent_of_loss", 100 * F.col("mean_gap") / F.col("mean_loss"))
    )


def subject_contrast(losses: DataFrame, left: str, right: str) -> DataFrame:
    """Mean of per-subject differences, share of positive subjects and paired effect size."""
    paired = condition_columns(losses, ["subject_id"], [left, right])
    gap = paired.select((F.col(left) - F.col(right)).alias("d")).dropna()
    return gap.agg(
        F.count(F.lit(1)).alias("subjects"),
        F.avg("d").alias("mean_difference"),
        F.avg((F.col("d") > 0).cast("double")).alias("positive_fraction"),
        (F.avg("d") / F.stddev_samp("d")).alias("effect_size"),
    )


def cluster_bootstrap(
    df: DataFrame, value: str, unit: str, replicates: int, seed: int = 0, level: float = 0.95
) -> DataFrame:
    """Percentile interval of a mean, resampling whole units with replacement.

    Rows collapse to one (sum, count) per unit first. Draws are numbers, turned into
    units by an equi-join on the unit's index.
    """
    units = df.groupBy(unit).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    n = units.count()
    indexed = seeded_index(units, [], seeded_key(seed, unit), [unit], out="_index", bound=n)
    slots = df.sparkSession.range(replicates * n).select(
        F.floor(F.col("id") / n).alias("replicate"),
        draw_below(seeded_key(seed, F.floor(F.col("id") / n), F.col("id") % n), n).alias("_index"),
    )
    means = (
        slots.join(indexed.select("_index", "_sum", "_n"), "_index")
        .groupBy("replicate")
        .agg((F.sum("_sum") / F.sum("_n")).alias("mean"))
    )
    tail = (1 - level) / 2
    interval = means.agg(
        F.count(F.lit(1)).alias("replicates"),
        F.percentile("mean", F.lit(tail)).alias("low"),
        F.percentile("mean", F.lit(1 - tail)).alias("high"),
    )
    point = units.agg(
        F.count(F.lit(1)).alias("units"), (F.sum("_sum") / F.sum("_n")).alias("estimate")
    )
    return point.join(F.broadcast(interval))


#: Units that share a block of the splitting tree.
TREE_BLOCK = 4096


def _draws(seed: int, *place: int) -> np.random.Generator:
    """A generator that depends on the seed and a place only."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed & (2**64 - 1), *place])))


def block_draws(seed: int, units: int, replicates: int, block: int, size: int = TREE_BLOCK) -> np.ndarray:
    """How many of a replicate's ``units`` draws fall into each unit of a block.

    A row per replicate. Draws are divided over the two halves of the range of blocks,
    again and again: binomially, by the units of each half. Every node has a generator of
    its own, so each block finds its share by walking down from the root, alone.
    """
    first, last = 0, -(-units // size)
    left = np.full(replicates, units, np.int64)
    while last - first > 1:
        half = (first + last) // 2
        below, whole = (half - first) * size, min(last * size, units) - first * size
        fell = _draws(seed, first, last).binomial(left, below / whole)
        if block < half:
            left, last = fell, half
        else:
            left, first = left - fell, half
    inside = min((block + 1) * size, units) - block * size
    return _draws(seed, block, block + 1, 1).multinomial(left, np.full(inside, 1 / inside))


def _resampled(seed: int, units: int, replicates: int, size: int):
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_index")
        block = int(frame["_index"].iloc[0]) // size
        counts = block_draws(seed, units, replicates, block, size)
        return pd.DataFrame(
            {
                "replicate": np.arange(replicates),
                "draws": counts.sum(axis=1),
                "sum": counts @ frame["_sum"].fillna(0.0).to_numpy(float),
                "n": counts @ frame["_n"].to_numpy(np.int64),
            }
        )

    return add


def bootstrap_means(
    df: DataFrame, value: str, unit: str, replicates: int, seed: int = 0, block: int = TREE_BLOCK
) -> DataFrame:
    """Mean of each replicate of a resampling of whole units, and the draws it consists of.

    Rows collapse to one (sum, count) per unit, units are numbered in seeded order, and each
    block of units takes its counts from a tree of binomial divisions. Blocks x replicates
    rows are moved; units are never copied or joined.
    """
    adapt(df.sparkSession)
    units = materialise(
        df.groupBy(unit).agg(F.sum(F.col(value).cast("double")).alias("_sum"), F.count(value).alias("_n"))
    )
    n = units.count()
    indexed = seeded_index(units, [], seeded_key(seed, unit), [unit], out="_index", bound=n)
    blocks = indexed.select("_index", "_sum", "_n", F.expr(f"_index div {block}").alias("_block"))
    # A group holds the units of one block.
    parts = blocks.groupBy("_block").applyInPandas(
        _resampled(seed, n, replicates, block), "replicate long, draws long, sum double, n long"
    )
    return parts.groupBy("replicate").agg(
        F.sum("draws").alias("draws"), (F.sum("sum") / F.nullif(F.sum("n"), F.lit(0))).alias("mean")
    )


def cluster_bootstrap_tree(
    df: DataFrame, value: str, unit: str, replicates: int, seed: int = 0, level: float = 0.95, block: int = TREE_BLOCK
) -> DataFrame:
    """Percentile interval of a mean over whole units, drawn block by block (see ``bootstrap_means``)."""
    means = bootstrap_means(df, value, unit, replicates, seed, block)
    tail = (1 - level) / 2
    interval = means.agg(
        F.count(F.lit(1)).alias("replicates"),
        F.sum("draws").alias("draws"),
        F.percentile("mean", F.lit(tail)).alias("low"),
        F.percentile("mean", F.lit(1 - tail)).alias("high"),
    )
    point = df.agg(F.countDistinct(unit).alias("units"), F.avg(value).alias("estimate"))
    return point.join(F.broadcast(interval))


def foreground_gap(losses: DataFrame, true: str, other: str, flag: str = "is_foreground") -> DataFrame:
    """Substitution gap on foreground and background targets and the foreground / all ratio."""
    wide = condition_columns(losses, ["sample_id", "mask_group", flag], [true, other])
    gaps = wide.select(flag, (F.col(other) - F.col(true)).alias("gap")).dropna()
    return gaps.agg(
        F.avg(F.when(F.col(flag), F.col("gap"))).alias("foreground_gap"),
        F.avg(F.when(~F.col(flag), F.col("gap"))).alias("background_gap"),
        F.avg("gap").alias("all_gap"),
    ).withColumn("foreground_over_all", F.col("foreground_gap") / F.col("all_gap"))


def foreground_target_share(masks: DataFrame, patches: DataFrame) -> DataFrame:
    """Share of masked target cells that hold any foreground."""
    targets = masks.filter("role = 'pred'").join(patches, ["sample_id", "cell"])
    return targets.agg(
        F.count(F.lit(1)).alias("targets"),
        F.avg(F.col("foreground").cast("double")).alias("foreground_share"),
    )


def rank_correlation(metrics: DataFrame, transfer: DataFrame, run: str = "run_id") -> DataFrame:
    """Spearman (average ties) and Pearson of every metric with transfer over runs.

    ``metrics`` has (run, metric, value), ``transfer`` has (run, transfer).
    """
    # One row per run and metric, read by both rankings.
    rows = materialise(metrics.join(transfer, run).select("metric", run, "value", "transfer"))
    ranked = average_ranks(rows, ["metric"], "value", "_rank")
    ranked = average_ranks(ranked, ["metric"], "transfer", "_transfer_rank")
    return ranked.groupBy("metric").agg(
        F.count(F.lit(1)).alias("runs"),
        correlation("_rank", "_transfer_rank").alias("spearman"),
        correlation("value", "transfer").alias("pearson"),
    )


def _tied_pairs(cells: DataFrame, *columns: str) -> DataFrame:
    counts = cells.groupBy(*columns).agg(F.sum("_n").alias("_c"))
    return counts.agg(F.coalesce(F.sum(F.col("_c") * (F.col("_c") - 1) / 2), F.lit(0.0)).alias("p"))


#: Rows of one bit's block that a task sorts at most in :func:`kendall`.
KENDALL_SLICE = 250_000


def kendall(df: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """Kendall's tau-b without forming pairs.

    Equal rows are one cell with its number ``_n``, so ``key`` decides nothing. Cells sorted
    by ``left`` carry the position of ``right`` as an integer. Two cells are discordant when
    the integers fall; that is counted at the highest bit in which they differ: cells sharing
    the bits above it form a group, and each cell with the bit clear counts the rows of the
    earlier cells with it set. One running sum per bit, so n log n rows for n cells; blocks
    above ``KENDALL_SLICE`` cells are cut into slices.
    """
    cells = materialise(df.groupBy(left, right).agg(F.count(F.lit(1)).alias("_n")))
    sizes = cells.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("cells")).first()
    n, bound = sizes["n"], sizes["cells"]
    counts = cells.groupBy(right).agg(F.count(F.lit(1)).alias("_ties"))
    places = sorted_index(counts, [], [F.col(right)], weights={"_y": F.col("_ties")}, bound=bound)
    placed = cells.join(places.select(right, "_y"), right)
    ordered = sorted_index(placed, [], [F.col(left), F.col("_y")], out="_x", bound=bound)
    bits = max(1, math.ceil(math.log2(max(bound, 2))))
    levels = ordered.select("_x", "_y", "_n", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("_bit"))
    power = F.pow(F.lit(2.0), F.col("_bit")).cast("bigint")
    split = levels.select(
        "_x",
        "_n",
        "_bit",
        F.floor(F.col("_y") / (power * 2)).alias("_block"),
        (F.floor(F.col("_y") / power) % 2).alias("_set"),
    )
    weights = {"_before": F.col("_set") * F.col("_n")}
    counted = sorted_index(
        split, ["_bit", "_block"], [F.col("_x")], weights=weights, rows_per_slice=KENDALL_SLICE, bound=bound
    )
    falling = F.col("_before") * F.col("_n")
    discordant = counted.filter("_set = 0").agg(F.coalesce(F.sum(falling), F.lit(0)).alias("discordant"))
    pairs = n * (n - 1) / 2
    merged = discordant
    for name, columns in (("_tx", [left]), ("_ty", [right]), ("_txy", [left, right])):
        merged = merged.join(F.broadcast(_tied_pairs(cells, *columns).withColumnRenamed("p", name)))
    concordant = F.lit(pairs) - F.col("_tx") - F.col("_ty") + F.col("_txy") - F.col("discordant")
    scale = F.sqrt((F.lit(pairs) - F.col("_tx")) * (F.lit(pairs) - F.col("_ty")))
    return merged.select(
        F.lit(n).cast("bigint").alias("runs"),
        concordant.cast("bigint").alias("concordant"),
        F.col("discordant").cast("bigint").alias("discordant"),
        F.when(scale > 0, (concordant - F.col("discordant")) / scale).alias("tau"),
    )


def label_reliability(losses: DataFrame, left: str, right: str) -> DataFrame:
    """Pearson correlation of a subject's measurements under two conditions."""
    wide = condition_columns(losses, ["subject_id"], [left, right]).dropna()
    return wide.agg(F.count(F.lit(1)).alias("subjects"), correlation(left, right).alias("reliability"))


def compliance_rate(losses: DataFrame, usual: str, asked: str) -> DataFrame:
    """Share of subjects whose mean rises from the usual to the asked condition."""
    wide = condition_columns(losses, ["subject_id"], [usual, asked]).dropna()
    return wide.agg(
        F.count(F.lit(1)).alias("subjects"),
        F.avg((F.col(asked) > F.col(usual)).cast("double")).alias("compliance"),
    )


def _det(rows: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def quadratic_holdout(runs: DataFrame, metric: str, transfer: str, level: str) -> DataFrame:
    """Error of a quadratic metric -> transfer fit on each held-out factor level.

    Moments are summed per level once; the fit that leaves a level out is the total
    minus that level, solved in closed form on the standardised metric.
    """
    runs = materialise(runs.select(metric, transfer, level))
    scale = runs.agg(F.avg(metric).alias("_m"), F.stddev_pop(metric).alias("_sd"))
    runs = runs.join(F.broadcast(scale)).withColumn("_z", (F.col(metric) - F.col("_m")) / F.col("_sd"))
    x, y = F.col("_z"), F.col(transfer)
    powers = {f"s{k}": F.sum(F.pow(x, F.lit(float(k)))) for k in range(5)}
    crosses = {f"t{k}": F.sum(y * F.pow(x, F.lit(float(k)))) for k in range(3)}
    names = [*powers, *crosses]
    by_level = runs.groupBy(level).agg(*[v.alias(k) for k, v in {**powers, **crosses}.items()])
    total = F.broadcast(by_level.agg(*[F.sum(k).alias(f"all_{k}") for k in names]))
    left = by_level.join(total).select(
        level, *[(F.col(f"all_{k}") - F.col(k)).alias(k) for k in names]
    )
    s = [F.col(f"s{k}") for k in range(5)]
    t = [F.col(f"t{k}") for k in range(3)]
    base = [[s[0], s[1], s[2]], [s[1], s[2], s[3]], [s[2], s[3], s[4]]]

    def swapped(k):
        return [[t[r] if c == k else base[r][c] for c in range(3)] for r in range(3)]

    solved = left.select(level, *[(_det(swapped(k)) / _det(base)).alias(f"b{k}") for k in range(3)])
    scored = runs.join(solved, level)
    error = scored[transfer] - (F.col("b0") + F.col("b1") * x + F.col("b2") * x * x)
    return scored.groupBy(level).agg(
        F.count(F.lit(1)).alias("runs"), F.sqrt(F.avg(error * error)).alias("quadratic_rmse")
    )


def isotonic_holdout(runs: DataFrame, metric: str, transfer: str, level: str, levels: list | None = None) -> DataFrame:
    """Error of a monotone metric -> transfer fit on each held-out factor level.

    Between pools the fit is linear, beyond them constant. ``levels`` restricts the report.
    """
    found = monotone.leave_one_out(runs, metric, transfer, level)
    kind = runs.schema[level].dataType
    out = found.select(
        F.col("level").cast(kind).alias(level), "runs", F.sqrt(F.abs("mse")).alias("isotonic_rmse")
    )
    return out if levels is None else out.filter(F.col(level).isin(list(levels)))
