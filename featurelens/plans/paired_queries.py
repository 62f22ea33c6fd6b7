"""Paired-condition geometry queries over embeddings and events."""

from pyspark.sql import functions as F

from featurelens.operators import paired
from featurelens.plans import views
from featurelens.plans.feature_queries import long_form, rounded
from featurelens.plans.registry import query
from featurelens.plans.views import ELEMENTS_SQL, FEATURES_SQL, LOSSES_SQL

# Centroids and displacements per subject and dimension.
MOVES_SQL = f"""{FEATURES_SQL}, {ELEMENTS_SQL},
  sp AS (SELECT subject_id, speed, dim, avg(x) AS c FROM elements GROUP BY ALL),
  cl AS (SELECT subject_id, clothing, dim, avg(x) AS c FROM elements GROUP BY ALL),
  pace AS (SELECT a.subject_id, a.dim, b.c - a.c AS d, a.c AS origin FROM sp a JOIN sp b USING (subject_id, dim)
    WHERE a.speed = 'UGS' AND b.speed = 'FGS'),
  coat AS (SELECT a.subject_id, a.dim, b.c - a.c AS d FROM cl a JOIN cl b USING (subject_id, dim)
    WHERE a.clothing = 'WoJ' AND b.clothing = 'WJ')"""


def pace(spark, sf):
    return paired.displacements(views.features(spark, sf), "speed", "UGS", "FGS")


def coat(spark, sf):
    return paired.displacements(views.features(spark, sf), "clothing", "WoJ", "WJ")


@query("displacements", f"WITH {MOVES_SQL} SELECT subject_id, dim, round(d, 9) AS x FROM pace")
def _(spark, sf):
    return long_form(pace(spark, sf), ["subject_id"])


@query(
    "relative_size",
    f"""WITH {MOVES_SQL}, n AS (SELECT subject_id, sqrt(sum(d * d)) AS a FROM coat GROUP BY 1),
    m AS (SELECT subject_id, sqrt(sum(d * d)) AS b FROM pace GROUP BY 1)
    SELECT subject_id, round(a, 9) AS first_norm, round(b, 9) AS second_norm, round(a / b, 9) AS ratio FROM n JOIN m USING (subject_id)""",
)
def _(spark, sf):
    out = paired.relative_size(coat(spark, sf), pace(spark, sf))
    return rounded(out, "first_norm", "second_norm", "ratio")


@query(
    "transport",
    f"""WITH {MOVES_SQL}, move AS (SELECT dim, avg(d) AS m FROM pace WHERE subject_id IN ('S0', 'S1', 'S2', 'S3') GROUP BY dim),
    q AS (SELECT subject_id, dim, origin + m AS x FROM pace JOIN move USING (dim) WHERE subject_id NOT IN ('S0', 'S1', 'S2', 'S3')),
    cand AS (SELECT subject_id || '/' || speed AS cell, dim, c FROM sp WHERE subject_id NOT IN ('S0', 'S1', 'S2', 'S3')),
    dist AS (SELECT q.subject_id, q.subject_id || '/FGS' AS cell, cand.cell AS name, sum(pow(x - c, 2)) AS d
      FROM q JOIN cand USING (dim) GROUP BY ALL)
    SELECT subject_id, cell, min_by(name, d) AS prediction, count(*) FILTER (d < own) + 1 AS true_rank
    FROM (SELECT *, max(d) FILTER (name = cell) OVER (PARTITION BY subject_id) AS own FROM dist) GROUP BY ALL""",
)
def _(spark, sf):
    rows = views.features(spark, sf)
    donors = rows.select("subject_id").distinct().filter(F.col("subject_id").isin("S0", "S1", "S2", "S3"))
    return paired.transport(rows, "speed", "UGS", "FGS", donors)


@query(
    "composition_residual",
    f"""WITH {MOVES_SQL}, c AS (SELECT subject_id, dim, avg(x) FILTER (speed = 'UGS' AND clothing = 'WoJ') AS c00,
      avg(x) FILTER (speed = 'FGS' AND clothing = 'WoJ') AS c10, avg(x) FILTER (speed = 'UGS' AND clothing = 'WJ') AS c01,
      avg(x) FILTER (speed = 'FGS' AND clothing = 'WJ') AS c11 FROM elements GROUP BY ALL),
    n AS (SELECT subject_id, sqrt(sum(pow(c11 - c00, 2))) AS j, sqrt(sum(pow(c10 - c00 + c01 - c00 - (c11 - c00), 2))) AS r FROM c GROUP BY 1)
    SELECT subject_id, round(j, 9) AS joint_norm, round(r, 9) AS residual_norm, round(r / j, 9) AS relative_residual FROM n""",
)
def _(spark, sf):
    out = paired.composition_residual(
        views.features(spark, sf), ("speed", "UGS", "FGS"), ("clothing", "WoJ", "WJ")
    )
    return rounded(out, "joint_norm", "residual_norm", "relative_residual")


@query("displacement_spectrum")
def _(spark, sf):
    return paired.displacement_spectrum(pace(spark, sf))


@query(
    "displacement_energy",
    f"""WITH {MOVES_SQL} SELECT round(sum(d * d), 9) AS energy FROM pace""",
)
def _(spark, sf):
    spectrum = paired.displacement_spectrum(pace(spark, sf))
    total = F.sum(F.col("singular_value") * F.col("singular_value"))
    return rounded(spectrum.agg(total.alias("energy")), "energy")


@query("selectivity")
def _(spark, sf):
    view = paired.displacements(views.features(spark, sf), "direction", "R2L", "L2R")
    return paired.selectivity({"pace": pace(spark, sf), "coat": coat(spark, sf), "view": view}, rank=4)


BASELINE_SQL = f"""{LOSSES_SQL}, pop AS (SELECT avg(loss) AS g FROM losses),
  h AS (SELECT loss, unnest([2, 4, 8]) AS history, unnest([
      CASE WHEN count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) = 2 THEN avg(loss) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) END,
      CASE WHEN count(*) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 4 THEN avg(loss) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END,
      CASE WHEN count(*) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) = 8 THEN avg(loss) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) END]) AS p
    FROM losses WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(
    "personal_baseline",
    f"""WITH {BASELINE_SQL.replace('OVER (w ROWS', 'OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS').replace(' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)', '')}
    SELECT history, count(*) AS "rows", round(avg(abs(loss - p)), 9) AS personal_error, round(avg(abs(loss - g)), 9) AS population_error,
      round(avg((abs(loss - p) < abs(loss - g))::INTEGER), 9) AS personal_wins FROM h, pop WHERE p IS NOT NULL GROUP BY history""",
)
def _(spark, sf):
    out = paired.personal_baseline(views.losses(spark, sf), "user_id", ["ts", "event_id"], "loss", [2, 4, 8])
    return rounded(out, "personal_error", "population_error", "personal_wins")


@query(
    "sufficiency_curve",
    f"""WITH {LOSSES_SQL}, c AS (SELECT CAST(hour(ts) AS BIGINT) AS budget, avg(loss) FILTER (condition = 'view') AS l,
      avg(loss) FILTER (condition = 'error') AS b, count(*) AS n FROM losses GROUP BY 1)
    SELECT budget, round(l, 9) AS loss, n AS "rows", round(b - l, 9) AS advantage,
      round(lag(l) OVER (ORDER BY budget) - l, 9) AS gain FROM c""",
)
def _(spark, sf):
    rows = views.losses(spark, sf).withColumn("budget", F.hour("ts").cast("bigint"))
    out = paired.sufficiency_curve(rows, "budget", "view", "error")
    return rounded(out, "loss", "advantage", "gain")
