"""Seeded wrong contexts: one matched partner per window, found without pairing rows.

All windows get one global order in which a subject, and inside it a recording, is a
contiguous run. The rows that qualify as partners are then an interval of positions
(with wrap-around), a partner is a number drawn from it, and one equi-join on the
position fetches the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.functions.hashing import draw_below, seeded_key
from featurelens.functions.ranking import seeded_index
from featurelens.session import materialise

KINDS = ["same_recording", "same_subject", "cross_subject"]


def _placed(windows: DataFrame, key: str, seed: int, total: int) -> DataFrame:
    recordings = windows.groupBy("subject_id", "recording_id").agg(F.count(F.lit(1)).alias("_m"))
    recordings = seeded_index(
        recordings, ["subject_id"], seeded_key(seed, "recording_id"), ["recording_id"],
        weights={"_a": F.col("_m")}, bound=total,
    )
    subjects = recordings.groupBy("subject_id").agg(F.sum("_m").alias("_n"))
    subjects = seeded_index(
        subjects, [], seeded_key(seed, "subject_id"), ["subject_id"], weights={"_s": F.col("_n")}, bound=total
    )
    ranked = seeded_index(
        windows, ["subject_id", "recording_id"], seeded_key(seed, key), [key], out="_r", bound=total
    )
    placed = ranked.join(recordings, ["subject_id", "recording_id"]).join(subjects, "subject_id")
    # Narrow, and read twice: as windows that ask and as windows that answer.
    return materialise(
        placed.select(
            key, "_m", "_n", "_a", "_s", "_r",
            (F.col("_s") + F.col("_a") + F.col("_r")).alias("_position"),
        )
    )


def matched_contexts(windows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """For every window one other window of each kind that exists.

    ``same_recording``: another time of the recording; ``same_subject``: another
    recording of the subject; ``cross_subject``: any other subject.
    """
    total = windows.count()
    placed = _placed(windows, key, seed, total)
    m, n, r = F.col("_m"), F.col("_n"), F.col("_r")
    draw = seeded_key(seed, key, F.lit("partner"))
    one = F.lit(1).cast("bigint")
    same_recording = F.col("_s") + F.col("_a") + (
        r + 1 + draw_below(draw, F.greatest(m - 1, one), 0)
    ) % m
    same_subject = F.col("_s") + (
        F.col("_a") + m + draw_below(draw, F.greatest(n - m, one), 1)
    ) % n
    cross = (F.col("_s") + n + draw_below(draw, F.greatest(F.lit(total) - n, one), 2)) % total
    wanted = placed.select(
        key,
        F.inline(
            F.array(
                F.struct(F.lit(KINDS[0]).alias("kind"), F.when(m > 1, same_recording).alias("_position")),
                F.struct(F.lit(KINDS[1]).alias("kind"), F.when(n > m, same_subject).alias("_position")),
                F.struct(F.lit(KINDS[2]).alias("kind"), F.when(F.lit(total) > n, cross).alias("_position")),
            )
        ),
    ).filter(F.col("_position").isNotNull())
    partners = placed.select("_position", F.col(key).alias("partner"))
    return wanted.join(partners, "_position").drop("_position")


def phase_filtered_contexts(
    windows: DataFrame, key: str, max_period: int, tolerance: int, seed: int = 0
) -> DataFrame:
    """Another time of the same recording whose phase differs by more than ``tolerance``.

    ``windows`` has ``window_start`` and the recording's ``period`` (at most
    ``max_period``). Ordered by phase, the phases to avoid are one circular run, so the
    rest is again an interval to draw from. Windows without a candidate get no row.
    """
    phased = windows.withColumn("phase", F.col("window_start") % F.col("period"))
    counts = phased.groupBy("recording_id").agg(
        F.max("period").alias("_p"),
        F.array(*[F.count(F.when(F.col("phase") == k, 1)) for k in range(max_period)]).alias("_counts"),
    )
    inside = seeded_index(
        phased, ["recording_id", "phase"], seeded_key(seed, key), [key], out="_i"
    )
    joined = inside.join(counts, "recording_id")

    def below(phase):
        part = F.slice("_counts", F.lit(1), phase.cast("int"))
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, c: acc + c)

    size = F.aggregate("_counts", F.lit(0).cast("bigint"), lambda acc, c: acc + c)
    near = F.aggregate(
        F.sequence(F.lit(-tolerance), F.lit(tolerance)),
        F.lit(0).cast("bigint"),
        lambda acc, d: acc
        + F.get(F.col("_counts"), F.pmod(F.col("phase") + d, F.col("_p")).cast("int")),
    )
    ready = materialise(joined.select(
        key,
        "recording_id",
        "phase",
        "period",
        (below(F.col("phase")) + F.col("_i")).alias("_position"),
        size.alias("_size"),
        F.when(F.lit(2 * tolerance + 1) < F.col("_p"), size - near)
        .otherwise(F.lit(0))
        .alias("_allowed"),
        below((F.col("phase") + tolerance + 1) % F.col("_p")).alias("_from"),
    ))
    draw = draw_below(seeded_key(seed, key, F.lit("phase")), F.greatest(F.col("_allowed"), F.lit(1).cast("bigint")))
    wanted = ready.filter("_allowed > 0").select(
        key, "recording_id", "phase", "period", ((F.col("_from") + draw) % F.col("_size")).alias("_position")
    )
    partners = ready.select(
        "recording_id", "_position", F.col(key).alias("partner"), F.col("phase").alias("partner_phase")
    )
    return wanted.join(partners, ["recording_id", "_position"]).drop("_position")
