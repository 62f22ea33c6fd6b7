"""Paired-condition geometry: displacements, transport, composition and baselines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelens.functions import vectors as vec
from featurelens.functions.ranking import sorted_index
from featurelens.operators.moments import gram, spectrum_rank
from featurelens.operators.probes import nearest_centroid
from featurelens.session import materialise

CHUNK_ROWS = 100_000


def condition_centroids(df: DataFrame, factor: str) -> DataFrame:
    """Mean vector per subject and factor level."""
    return df.groupBy("subject_id", factor).agg(vec.means("features").alias("centre"))


def displacements(df: DataFrame, factor: str, start: str, end: str) -> DataFrame:
    """Per subject the vector from one condition's centroid to the other's."""
    centres = condition_centroids(df.filter(F.col(factor).isin(start, end)), factor)

    def side(level):
        return F.max(F.when(F.col(factor) == level, F.col("centre")))

    both = centres.groupBy("subject_id").agg(side(start).alias("origin"), side(end).alias("_to"))
    return both.dropna().select(
        "subject_id", vec.minus("_to", "origin").alias("features"), "origin"
    )


def relative_size(first: DataFrame, second: DataFrame) -> DataFrame:
    """Norms of two displacements of each subject and their ratio."""
    a = first.select("subject_id", vec.norm("features").alias("first_norm"))
    b = second.select("subject_id", vec.norm("features").alias("second_norm"))
    ratio = F.when(F.col("second_norm") > 0, F.col("first_norm") / F.col("second_norm"))
    return a.join(b, "subject_id").withColumn("ratio", ratio)


def transport(
    df: DataFrame, factor: str, start: str, end: str, donors: DataFrame
) -> DataFrame:
    """Move held-out subjects by the donors' mean displacement and rank the true target.

    Candidates are all held-out (subject, condition) centroids; the rank is by
    Euclidean distance.
    """
    given = df.join(donors, "subject_id", "left_semi")
    held = df.join(donors, "subject_id", "left_anti")
    # One vector.
    mean = F.broadcast(
        displacements(given, factor, start, end).agg(vec.means("features").alias("_move"))
    )
    cells = condition_centroids(held, factor).select(
        F.concat_ws("/", "subject_id", factor).alias("cell"), F.col("centre").alias("features")
    )
    moved = displacements(held, factor, start, end).join(mean).select(
        "subject_id",
        F.concat_ws("/", F.col("subject_id"), F.lit(end)).alias("cell"),
        vec.plus("origin", "_move").alias("features"),
    )
    return nearest_centroid(moved, cells, "cell", "subject_id", metric="euclidean")


def composition_residual(
    df: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str]
) -> DataFrame:
    """How far two single-factor displacements miss the joint one, per subject.

    A factor is ``(column, from, to)``. One row per subject holds its four cells.
    """
    (a, a0, a1), (b, b0, b1) = first, second
    rows = df.filter(F.col(a).isin(a0, a1) & F.col(b).isin(b0, b1))
    centres = rows.groupBy("subject_id", a, b).agg(vec.means("features").alias("centre"))

    def cell(x, y):
        return F.max(F.when((F.col(a) == x) & (F.col(b) == y), F.col("centre")))

    wide = centres.groupBy("subject_id").agg(
        cell(a0, b0).alias("c00"), cell(a1, b0).alias("c10"), cell(a0, b1).alias("c01"), cell(a1, b1).alias("c11")
    ).dropna()
    joint = vec.minus("c11", "c00")
    summed = vec.plus(vec.minus("c10", "c00"), vec.minus("c01", "c00"))
    sized = wide.select(
        "subject_id",
        vec.norm(joint).alias("joint_norm"),
        vec.norm(vec.minus(summed, joint)).alias("residual_norm"),
    )
    return sized.withColumn(
        "relative_residual", F.when(F.col("joint_norm") > 0, F.col("residual_norm") / F.col("joint_norm"))
    )


def displacement_spectrum(moves: DataFrame) -> DataFrame:
    """Singular values of the subject x dimension matrix of displacements.

    They are square roots of the eigenvalues of its D x D product matrix, which is what
    reaches the last task.
    """
    def solve(frame):
        products = np.stack(frame.sort_values("dim")["products"].to_numpy())
        values = np.sqrt(np.clip(np.linalg.eigvalsh(products)[::-1], 0.0, None))
        energy = values**2
        return pd.DataFrame(
            {
                "component": np.arange(len(values)),
                "singular_value": values,
                "energy_share": energy / energy.sum() if energy.sum() > 0 else energy,
                "effective_rank": spectrum_rank(products),
            }
        )

    schema = "component bigint, singular_value double, energy_share double, effective_rank double"
    return gram(moves).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(solve, schema)


def selectivity(families: dict[str, DataFrame], rank: int) -> DataFrame:
    """Share of each displacement family's energy in the leading span of every other.

    The span of a family is its first ``rank`` principal directions (uncentred). With
    product matrices G the share is tr(P_b G_a) / tr(G_a): D x D matrices suffice.
    """
    stacked = None
    for name, moves in families.items():
        part = moves.select(F.lit(name).alias("family"), "features")
        stacked = part if stacked is None else stacked.unionByName(part)

    def solve(frame):
        matrices = {
            name: np.stack(part.sort_values("dim")["products"].to_numpy())
            for name, part in frame.groupby("family")
        }
        rows = []
        for other, matrix in matrices.items():
            basis = np.linalg.eigh(matrix)[1][:, ::-1][:, :rank]
            for name, own in matrices.items():
                energy = np.trace(own)
                share = np.trace(basis.T @ own @ basis) / energy if energy > 0 else None
                rows.append((name, other, share))
        return pd.DataFrame(rows, columns=["displacement", "span", "energy_share"])

    schema = "displacement string, span string, energy_share double"
    products = gram(stacked, ["family"]).withColumn("_all", F.lit(0))
    return products.groupBy("_all").applyInPandas(solve, schema)


def rolling_history(
    df: DataFrame, subject: str, order: list[str], value: str, lengths: list[int], chunk: int = CHUNK_ROWS
) -> DataFrame:
    """Mean and spread of each row's preceding ``n`` values of its subject, per length.

    A subject's rows are cut into chunks; each chunk also gets the last rows of the one
    before it, so windows are exact and no task holds a whole subject.
    """
    halo = max(lengths)
    if chunk < halo:
        raise ValueError("chunks must be at least as long as the longest history")
    indexed = sorted_index(df, [subject], [F.col(c) for c in order], out="_r")
    home = F.floor(F.col("_r") / chunk)
    trailing = F.col("_r") % chunk >= chunk - halo
    copies = F.when(trailing, F.array(home, home + 1)).otherwise(F.array(home))
    spread = indexed.withColumn("_home", home).withColumn("_chunk", F.explode(copies))
    frame = Window.partitionBy(subject, "_chunk").orderBy("_r")
    columns = []
    for n in lengths:
        past = frame.rowsBetween(-n, -1)
        columns += [
            F.avg(value).over(past).alias(f"mean_{n}"),
            F.stddev_pop(value).over(past).alias(f"std_{n}"),
            F.count(value).over(past).alias(f"seen_{n}"),
        ]
    windowed = spread.select("*", *columns)
    return windowed.filter("_chunk = _home").drop("_r", "_home", "_chunk")


def personal_baseline(
    df: DataFrame, subject: str, order: list[str], value: str, lengths: list[int]
) -> DataFrame:
    """Error of the personal mean over ``n`` past values against the population mean."""
    rolled = rolling_history(df, subject, order, value, lengths)
    centre = F.broadcast(df.agg(F.avg(value).alias("_population")))
    rows = rolled.join(centre).select(
        F.col(value).alias("_x"),
        "_population",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).cast("bigint").alias("history"),
                        F.when(F.col(f"seen_{n}") == n, F.col(f"mean_{n}")).alias("_personal"),
                    )
                    for n in lengths
                ]
            )
        ),
    ).filter(F.col("_personal").isNotNull())
    personal, population = F.abs(F.col("_x") - F.col("_personal")), F.abs(F.col("_x") - F.col("_population"))
    return rows.groupBy("history").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(personal).alias("personal_error"),
        F.avg(population).alias("population_error"),
        F.avg((personal < population).cast("double")).alias("personal_wins"),
    )


def sufficiency_curve(losses: DataFrame, budget: str, true: str, blank: str) -> DataFrame:
    """Loss and context advantage per observation budget, with the gain over the last one."""
    wide = losses.groupBy(budget).agg(
        F.avg(F.when(F.col("condition") == true, F.col("loss"))).alias("loss"),
        F.avg(F.when(F.col("condition") == blank, F.col("loss"))).alias("_blank"),
        F.count(F.lit(1)).alias("rows"),
    )
    curve = wide.withColumn("advantage", F.col("_blank") - F.col("loss")).drop("_blank")
    placed = sorted_index(materialise(curve), [], [F.col(budget)], out="_i")
    earlier = placed.select((F.col("_i") + 1).alias("_i"), F.col("loss").alias("_earlier"))
    gain = F.col("_earlier") - F.col("loss")
    return placed.join(earlier, "_i", "left").withColumn("gain", gain).drop("_i", "_earlier")
