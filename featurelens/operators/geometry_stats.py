"""Where token variance sits: clips, positions and the rest; ranks, floors and nulls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurelens.functions import vectors as vec
from featurelens.functions.hashing import seeded_key
from featurelens.functions.ranking import bottom_k, seeded_index, sorted_index
from featurelens.operators import deals
from featurelens.operators.moments import (
    gram,
    pool_tokens,
    spectral_rows,
    spectral_stats,
    spectrum_rank,
    unpack,
    vector_totals,
)
from featurelens.session import adapt, materialise


def token_accumulators(tokens: DataFrame, group=(), width: int | None = None) -> DataFrame:
    """Vector sums per clip and per position from one scan.

    Rows with ``is_clip`` carry one clip's token count, vector sum and squared total;
    the others carry the same for one position. The state is mergeable, and the map
    side combines it before the single shuffle.
    """
    group = list(group)
    totals = vector_totals(tokens, [[*group, "clip_id"], [*group, "pos"]], width)
    return totals.withColumn("is_clip", F.col("set") == 0).drop("set")


def _only(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def shares(accumulators: DataFrame, group=(), width: int | None = None) -> DataFrame:
    """Exact clip / position / residual traces from the accumulators (population)."""
    clip, place = F.col("is_clip"), ~F.col("is_clip")
    zeros = F.transform("total", lambda x: F.lit(0.0))
    mean_square = vec.squared_norm("total") / (F.col("tokens") * F.col("tokens"))
    merged = accumulators.groupBy(*group).agg(
        F.count(_only(clip, F.lit(1))).alias("clips"),
        F.count(_only(place, F.lit(1))).alias("positions_per_clip"),
        F.sum(_only(clip, F.col("tokens"))).alias("tokens"),
        F.sum(_only(clip, F.col("squares"))).alias("_q"),
        vec.sums(F.when(clip, F.col("total")).otherwise(zeros), width).alias("_s"),
        F.sum(_only(clip, mean_square)).alias("_clip"),
        F.sum(_only(place, mean_square)).alias("_pos"),
        F.min(_only(clip, F.col("tokens"))).alias("_least"),
        F.max(_only(clip, F.col("tokens"))).alias("_most"),
        F.min(_only(place, F.col("tokens"))).alias("_thin"),
        F.max(_only(place, F.col("tokens"))).alias("_thick"),
    )
    balanced = (F.col("_least") == F.col("_most")) & (F.col("_thin") == F.col("_thick"))
    guard = F.when(~balanced, F.raise_error(F.lit("unequal token counts: use weighted_shares")))
    n = F.col("tokens")
    mu = vec.squared_norm("_s") / (n * n)
    total = F.col("_q") / n - mu + F.coalesce(guard.cast("double"), F.lit(0.0))
    clip_trace = F.col("_clip") / F.col("clips") - mu
    place_trace = F.col("_pos") / F.col("positions_per_clip") - mu
    within = F.col("trace_total") - F.col("trace_clip")
    traced = merged.select(
        *group,
        "clips",
        "positions_per_clip",
        F.size("_s").cast("bigint").alias("dim"),
        total.alias("trace_total"),
        clip_trace.alias("trace_clip"),
        place_trace.alias("trace_position"),
    ).select(
        "*",
        within.alias("trace_within"),
        (within - F.col("trace_position")).alias("trace_residual"),
    )
    return traced.select(
        "*",
        _ratio("trace_clip", "trace_total").alias("beta"),
        _ratio("trace_position", "trace_within").alias("position_share_of_within"),
        _ratio("trace_residual", "trace_within").alias("residual_share_of_within"),
    )


def _ratio(top, bottom) -> Column:
    bottom = F.col(bottom) if isinstance(bottom, str) else bottom
    top = F.col(top) if isinstance(top, str) else top
    return F.when(bottom != 0, top / bottom)


def position_share(tokens: DataFrame, group=(), width: int | None = None) -> DataFrame:
    """Split token variance into clip, position and residual traces."""
    return shares(token_accumulators(tokens, group, width), group, width)


def leakage_floor(traces: DataFrame) -> DataFrame:
    """Between-clip trace against the sampling floor of the pooled mean.

    The naive floor spreads all within-clip variance over the tokens; the corrected one
    only the residual, because the position effect is equal in every clip.
    """
    t = F.col("positions_per_clip")
    return (
        traces.withColumn("naive_floor", F.col("trace_within") / t)
        .withColumn("corrected_floor", F.col("trace_residual") / t)
        .withColumn("observed_over_naive", _ratio("trace_clip", "naive_floor"))
        .withColumn("observed_over_corrected", _ratio("trace_clip", "corrected_floor"))
    )


def dense_share(traces: DataFrame) -> DataFrame:
    """The residual and position shares of all token variance beside beta."""
    return traces.withColumn("gamma", _ratio("trace_residual", "trace_total")).withColumn(
        "position_share", _ratio("trace_position", "trace_total")
    )


def weighted_shares(tokens: DataFrame, width: int | None = None) -> DataFrame:
    """Between / within split when clips hold different numbers of tokens.

    Every token weighs the same, so a clip mean counts as often as it has tokens.
    """
    by_clip = vector_totals(tokens, [["clip_id"]], width)
    merged = by_clip.agg(
        F.count(F.lit(1)).alias("clips"),
        F.sum("tokens").alias("tokens"),
        F.min("tokens").alias("min_tokens"),
        F.max("tokens").alias("max_tokens"),
        F.sum("squares").alias("_q"),
        F.sum(vec.squared_norm("total") / F.col("tokens")).alias("_clip"),
        vec.sums("total", width).alias("_s"),
    )
    n = F.col("tokens")
    mu = vec.squared_norm("_s") / (n * n)
    return (
        merged.withColumn("trace_total", F.col("_q") / n - mu)
        .withColumn("trace_between", F.col("_clip") / n - mu)
        .withColumn("trace_within", F.col("trace_total") - F.col("trace_between"))
        .withColumn("beta", _ratio("trace_between", "trace_total"))
        .drop("_q", "_clip", "_s")
    )


def between_within(tokens: DataFrame, width: int | None = None) -> DataFrame:
    """Traces of the between-clip and within-clip covariance, equal tokens per clip."""
    row = weighted_shares(tokens, width)
    equal = F.col("min_tokens") == F.col("max_tokens")
    guard = F.when(~equal, F.raise_error(F.lit("unequal token counts: use weighted_shares")))
    return row.withColumn(
        "trace_between", F.col("trace_between") + F.coalesce(guard.cast("double"), F.lit(0.0))
    ).drop("min_tokens", "max_tokens")


def variance_decomposition(tokens: DataFrame, width: int | None = None) -> DataFrame:
    """Traces and effective ranks of total, between-clip and within-clip covariance.

    The within matrix is total minus between, so tokens are never joined back to their
    clip means; two D x D matrices reach the final task.
    """
    clips = pool_tokens(tokens, ["clip_id"], width)
    both = gram(tokens).withColumn("part", F.lit("token")).unionByName(
        gram(clips).withColumn("part", F.lit("clip"))
    )
    schema = T.StructType(
        [T.StructField("clips", T.LongType()), T.StructField("tokens", T.LongType())]
        + [
            T.StructField(c, T.DoubleType())
            for c in ("trace_between", "trace_within", "beta")
            + ("rank_token", "rank_between", "rank_within")
        ]
    )

    def solve(frame):
        clips_n, _, between = unpack(frame[frame["part"] == "clip"])
        tokens_n, _, total = unpack(frame[frame["part"] == "token"])
        within = total - between
        row = [clips_n, tokens_n, np.trace(between), np.trace(within)]
        row += [np.trace(between) / np.trace(total) if np.trace(total) > 0 else None]
        row += [spectrum_rank(total), spectrum_rank(between), spectrum_rank(within)]
        return pd.DataFrame([row], columns=schema.names)

    # 2 x D rows in all: the group is bounded by the feature width.
    return both.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(solve, schema)


def rank_report(populations: dict[str, DataFrame]) -> DataFrame:
    """Effective rank per named population (representation, axis and norm point)."""
    stacked = None
    for name, df in populations.items():
        part = df.select(F.lit(name).alias("population"), "features")
        stacked = part if stacked is None else stacked.unionByName(part)
    return spectral_stats(stacked, ["population"]).select(
        "population", "rows", "effective_rank", "feature_std"
    )


def sample_tokens(
    tokens: DataFrame, batch: str, key_columns: list[str], per_batch: int, in_all: int, seed: int = 0
) -> DataFrame:
    """At most ``per_batch`` seeded tokens of each batch and ``in_all`` overall.

    Batches are filled in order, as an accumulating reader would.
    """
    key = seeded_key(seed, batch, *key_columns)
    adapt(tokens.sparkSession)
    kept = bottom_k(tokens, [batch], key, key_columns, per_batch)
    placed = sorted_index(kept, [], [F.col(batch), F.col("draw")], out="_place")
    return placed.filter(F.col("_place") < in_all).drop("_place")


def permutation_null(
    tokens: DataFrame, replicates: int, seed: int = 0, width: int | None = None
) -> DataFrame:
    """Beta of each replicate with clip labels permuted inside every position.

    The k-th clip of a position, by name, gives its token to the clip that is k-th in an
    order drawn for that replicate and position, so labels are permuted independently at
    every position. Only (clip, position) keys are ranked; vectors move once, whatever the
    number of replicates, and are folded where the positions of a block are.
    Totals and position effects do not change.
    """
    width = width or vec.vector_width(tokens)
    dealt, clips = deals.deals(tokens, replicates, seed)
    by_clip = deals.merged(deals.dealt_sums(tokens, dealt, clips, replicates, width))
    # One row: neither the sum of all tokens nor their squares depend on the deal.
    everything = vector_totals(tokens.withColumn("_all", F.lit(0)), [["_all"]], width).select(
        F.col("squares").alias("_q"), F.col("total").alias("_s")
    )
    n_tokens = F.col("tokens")
    mu = vec.squared_norm("_s") / (n_tokens * n_tokens)
    between, total = F.col("by_clip") / n_tokens - mu, F.col("_q") / n_tokens - mu
    return by_clip.join(F.broadcast(everything)).select(
        "replicate", between.alias("trace_between"), _ratio(between, total).alias("beta")
    )


def population_stability(
    tokens: DataFrame, fractions: list[float], replicates: int, seed: int = 0, width: int | None = None
) -> DataFrame:
    """Beta, effective rank and spread on seeded clip subsets of growing size.

    Subsets of one replicate are nested, so a clip enters only the smallest that holds it.
    Moments are summed per rung (what a subset adds to the one before), and a subset is the
    sum of its rungs: clips x replicates rows are read, however many sizes there are.
    """
    clips = materialise(vector_totals(tokens, [["clip_id"]], width))
    n = clips.count()
    sizes = sorted({max(2, round(f * n)) for f in fractions})
    copies = clips.withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    )
    key = seeded_key(seed, "replicate", "clip_id")
    ranked = seeded_index(copies, ["replicate"], key, ["clip_id"], out="_order", bound=n)
    rung = F.coalesce(*[F.when(F.col("_order") < s, F.lit(s)) for s in sizes]).cast("bigint")
    entered = ranked.withColumn("rung", rung).filter("rung is not null")
    grouped = ["replicate", "rung"]
    added = entered.groupBy(*grouped).agg(
        F.sum("tokens").alias("tokens"),
        F.sum("squares").alias("_q"),
        F.sum(vec.squared_norm("total") / F.col("tokens")).alias("_clip"),
        vec.sums("total", width).alias("_s"),
    )
    group = ["replicate", "size"]
    up = F.explode(F.filter(F.array(*[F.lit(s).cast("bigint") for s in sizes]), lambda s: s >= F.col("rung")))
    n_tokens = F.col("tokens")
    mu = vec.squared_norm("_s") / (n_tokens * n_tokens)
    betas = added.withColumn("size", up).groupBy(*group).agg(
        F.sum("tokens").alias("tokens"),
        F.sum("_q").alias("_q"),
        F.sum("_clip").alias("_clip"),
        vec.sums("_s", width).alias("_s"),
    ).select(
        *group,
        _ratio(F.col("_clip") / n_tokens - mu, F.col("_q") / n_tokens - mu).alias("beta"),
    )
    pooled = entered.select(*grouped, vec.divided("total", F.col("tokens")).alias("features"))
    moments_of = gram(pooled, grouped).withColumn("size", up).groupBy(*group, "dim").agg(
        F.sum("rows").alias("rows"), F.sum("total").alias("total"), vec.sums("products").alias("products")
    )
    ranks = spectral_rows(moments_of, group).select(*group, "effective_rank", "feature_std")
    return betas.join(ranks, group)


def dense_labels(pixels: DataFrame, token: list[str], label: str) -> DataFrame:
    """Majority label of each token; ties go to the smallest label."""
    votes = pixels.groupBy(*token, label).agg(F.count(F.lit(1)).alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("n"), F.col(label).alias("label")))
    return votes.groupBy(*token).agg(best.alias("_best"), F.sum("votes").alias("pixels")).select(
        *token, F.col("_best.label").alias(label), "pixels"
    )
