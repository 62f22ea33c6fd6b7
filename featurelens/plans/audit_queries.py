"""Loss audit, resampling, association and wrong-context queries."""

from pyspark.sql import functions as F

from featurelens.functions.hashing import draw_below, seeded_key
from featurelens.operators import audits, contexts, series
from featurelens.plans import views
from featurelens.plans.feature_queries import rounded
from featurelens.plans.probe_queries import RUNS_SQL, SERIES_SQL, runs, series_frames
from featurelens.plans.registry import query
from featurelens.plans.sqltext import word
from featurelens.plans.views import LOSSES_SQL, RECORDINGS_SQL


def wide_sql(keys, conditions):
    columns = ", ".join(f"avg(loss) FILTER (condition = '{c}') AS \"{c}\"" for c in conditions)
    return f"wide AS (SELECT {keys}, {columns} FROM losses GROUP BY {keys})"


@query(
    "blank_context_delta",
    f"""WITH {LOSSES_SQL}, {wide_sql('sample_id, mask_group', ['view', 'error'])},
    e AS (SELECT sample_id, avg(error - "view") AS d FROM wide WHERE error IS NOT NULL AND "view" IS NOT NULL GROUP BY sample_id)
    SELECT round(avg(d), 9) AS blank_delta, count(*) AS examples FROM e""",
)
def _(spark, sf):
    return rounded(audits.context_delta(views.losses(spark, sf), "view", "error"), "blank_delta")


@query(
    "substitution_ladder",
    f"""WITH {LOSSES_SQL}, {wide_sql('sample_id, mask_group', ['view', 'click', 'purchase', 'signup', 'error'])},
    g AS (SELECT "view" AS t, c.condition, CASE c.condition WHEN 'view' THEN "view" WHEN 'click' THEN click
      WHEN 'purchase' THEN purchase WHEN 'signup' THEN signup ELSE error END - "view" AS gap
      FROM wide, (VALUES ('view'), ('click'), ('purchase'), ('signup'), ('error')) c(condition))
    SELECT condition, count(*) AS pairs, round(avg(gap), 9) AS mean_gap, round(avg(t), 9) AS mean_loss,
      round(100 * avg(gap) / avg(t), 9) AS percent_of_loss FROM g WHERE gap IS NOT NULL GROUP BY condition""",
)
def _(spark, sf):
    others = ["click", "purchase", "signup", "error"]
    out = audits.substitution_ladder(views.losses(spark, sf), "view", others)
    return rounded(out, "mean_gap", "mean_loss", "percent_of_loss")


@query(
    "subject_contrast",
    f"""WITH {LOSSES_SQL}, {wide_sql('subject_id', ['click', 'purchase'])},
    d AS (SELECT click - purchase AS d FROM wide WHERE click IS NOT NULL AND purchase IS NOT NULL)
    SELECT count(*) AS subjects, round(avg(d), 9) AS mean_difference, round(avg((d > 0)::INTEGER), 9) AS positive_fraction,
      round(avg(d) / stddev_samp(d), 9) AS effect_size FROM d""",
)
def _(spark, sf):
    out = audits.subject_contrast(views.losses(spark, sf), "click", "purchase")
    return rounded(out, "mean_difference", "positive_fraction", "effect_size")


@query(
    "cluster_bootstrap",
    f"""WITH {LOSSES_SQL}, u AS (SELECT subject_id, sum(loss) AS s, count(loss) AS n,
      row_number() OVER (ORDER BY md5('0-' || subject_id), subject_id) - 1 AS i FROM losses GROUP BY subject_id),
    size AS (SELECT count(*) AS k FROM u),
    d AS (SELECT r, {word("md5('0-' || r || '-' || slot)")} % k AS i
      FROM size, (SELECT unnest(range(200)) AS r), (SELECT unnest(range((SELECT k FROM size))) AS slot)),
    m AS (SELECT r, sum(s) / sum(n) AS m FROM d JOIN u USING (i) GROUP BY r)
    SELECT (SELECT k FROM size) AS units, round((SELECT sum(s) / sum(n) FROM u), 9) AS estimate, count(*) AS replicates,
      round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m""",
)
def _(spark, sf):
    out = audits.cluster_bootstrap(views.losses(spark, sf), "loss", "subject_id", replicates=200)
    return rounded(out, "estimate", "low", "high")


@query(
    "cluster_bootstrap_tree",
    f"""WITH {LOSSES_SQL}, u AS (SELECT subject_id, sum(loss) AS s, count(loss) AS n FROM losses GROUP BY subject_id)
    SELECT count(*) AS units, round(sum(s) / sum(n), 9) AS estimate, 200::BIGINT AS replicates, (200 * count(*))::BIGINT AS draws,
      true AS covered, true AS as_wide
    FROM u""",
)
def _(spark, sf):
    """The interval depends on binomial draws, so SQL sees what holds for any of them.

    ``as_wide``: its width is within a third of the normal interval of unit totals.
    """
    rows = views.losses(spark, sf)
    out = audits.cluster_bootstrap_tree(rows, "loss", "subject_id", replicates=200, block=64)
    totals = rows.groupBy("subject_id").agg(F.sum("loss").alias("s"), F.count("loss").alias("n"))
    rate = totals.agg((F.sum("s") / F.sum("n")).alias("rate"), F.sum("n").alias("all"))
    off = F.col("s") - F.col("rate") * F.col("n")
    # One row each.
    spread = totals.join(F.broadcast(rate)).agg((F.sqrt(F.sum(off * off)) / F.max("all")).alias("error"))
    width = (F.col("high") - F.col("low")) / (2 * 1.96 * F.col("error"))
    checked = out.join(F.broadcast(spread)).select(
        "units",
        "estimate",
        "replicates",
        "draws",
        F.col("estimate").between(F.col("low"), F.col("high")).alias("covered"),
        width.between(2 / 3, 4 / 3).alias("as_wide"),
    )
    return rounded(checked, "estimate")


@query(
    "foreground_gap",
    f"""WITH {LOSSES_SQL}, w AS (SELECT sample_id, mask_group, user_id % 3 = 0 AS f, avg(loss) FILTER (condition = 'view') AS t,
      avg(loss) FILTER (condition = 'click') AS o FROM losses GROUP BY ALL), g AS (SELECT f, o - t AS g FROM w WHERE o - t IS NOT NULL)
    SELECT round(avg(g) FILTER (f), 9) AS foreground_gap, round(avg(g) FILTER (NOT f), 9) AS background_gap,
      round(avg(g), 9) AS all_gap, round(avg(g) FILTER (f) / avg(g), 9) AS foreground_over_all FROM g""",
)
def _(spark, sf):
    rows = views.losses(spark, sf).withColumn("is_foreground", F.col("user_id") % 3 == 0)
    out = audits.foreground_gap(rows, "view", "click")
    return rounded(out, *out.columns)


@query(
    "foreground_target_share",
    f"""WITH p AS (SELECT l_orderkey AS sample_id, l_linenumber AS cell, max((l_discount > 0.07)::INTEGER) AS fg
      FROM lineitem GROUP BY ALL)
    SELECT count(*) AS targets, round(avg(fg), 9) AS foreground_share FROM p
    WHERE {word("md5('1-' || sample_id || '-' || cell)")} % 4 = 0""",
)
def _(spark, sf):
    lines = views.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("cell"), "l_discount"
    )
    patches = lines.groupBy("sample_id", "cell").agg(F.max(F.col("l_discount") > 0.07).alias("foreground"))
    role = F.when(draw_below(seeded_key(1, "sample_id", "cell"), 4) == 0, "pred").otherwise("ctx")
    masks = lines.select("sample_id", "cell").distinct().withColumn("role", role)
    return rounded(audits.foreground_target_share(masks, patches), "foreground_share")


@query(
    "rank_correlation",
    f"""WITH {RUNS_SQL}, m AS (SELECT run_id, transfer, 'mean' AS metric, round(metric / 500) AS value FROM runs
      UNION ALL SELECT run_id, transfer, 'spread', spread FROM runs),
    r AS (SELECT metric, value, transfer, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS a,
      rank() OVER (PARTITION BY metric ORDER BY transfer) + (count(*) OVER (PARTITION BY metric, transfer) - 1) / 2.0 AS b FROM m)
    SELECT metric, count(*) AS runs, round(corr(a, b), 9) AS spearman, round(corr(value, transfer), 9) AS pearson FROM r GROUP BY metric""",
)
def _(spark, sf):
    rows = runs(spark, sf)
    metrics = rows.select(
        "run_id",
        F.inline(
            F.array(
                F.struct(F.lit("mean").alias("metric"), F.round(F.col("metric") / 500).alias("value")),
                F.struct(F.lit("spread").alias("metric"), F.col("spread").alias("value")),
            )
        ),
    )
    out = audits.rank_correlation(metrics, rows.select("run_id", "transfer"))
    return rounded(out, "spearman", "pearson")


SPENDING_SQL = """spend AS (SELECT c_custkey AS run_id, floor(c_acctbal / 100) AS metric, c_mktsegment AS level, c_acctbal,
    coalesce(t, 0) AS transfer FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS t FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""


def spending(spark, sf):
    orders = views.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("t")
    )
    customers = views.table(spark, sf, "customer").join(orders, "c_custkey", "left")
    return customers.select(
        F.col("c_custkey").alias("run_id"),
        F.floor(F.col("c_acctbal") / 100).alias("metric"),
        F.col("c_mktsegment").alias("level"),
        "c_acctbal",
        F.coalesce("t", F.lit(0)).alias("transfer"),
    )


@query(
    "kendall",
    f"""WITH {SPENDING_SQL}, p AS (SELECT sign(a.metric - b.metric) * sign(a.transfer - b.transfer) AS s,
      (a.metric = b.metric)::INTEGER AS tx, (a.transfer = b.transfer)::INTEGER AS ty FROM spend a JOIN spend b ON a.run_id < b.run_id)
    SELECT (SELECT count(*) FROM spend) AS runs, count(*) FILTER (s > 0) AS concordant, count(*) FILTER (s < 0) AS discordant,
      round((count(*) FILTER (s > 0) - count(*) FILTER (s < 0)) / sqrt((count(*) - sum(tx))::DOUBLE * (count(*) - sum(ty))), 9) AS tau FROM p""",
)
def _(spark, sf):
    return rounded(audits.kendall(spending(spark, sf), "metric", "transfer", "run_id"), "tau")


@query(
    "label_reliability",
    f"""WITH {LOSSES_SQL}, {wide_sql('subject_id', ['click', 'signup'])}
    SELECT count(*) AS subjects, round(corr(click, signup), 9) AS reliability FROM wide WHERE click IS NOT NULL AND signup IS NOT NULL""",
)
def _(spark, sf):
    return rounded(audits.label_reliability(views.losses(spark, sf), "click", "signup"), "reliability")


@query(
    "compliance_rate",
    f"""WITH {LOSSES_SQL}, {wide_sql('subject_id', ['view', 'purchase'])}
    SELECT count(*) AS subjects, round(avg((purchase > "view")::INTEGER), 9) AS compliance FROM wide
    WHERE purchase IS NOT NULL AND "view" IS NOT NULL""",
)
def _(spark, sf):
    return rounded(audits.compliance_rate(views.losses(spark, sf), "view", "purchase"), "compliance")


@query(
    "quadratic_holdout",
    f"""WITH {SPENDING_SQL}, s AS (SELECT level, transfer AS y, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x FROM spend),
    lv AS (SELECT DISTINCT level AS h FROM s), fit AS (SELECT h, x, x * x AS xx, y FROM s JOIN lv ON level <> h),
    lin AS (SELECT h, regr_slope(xx, x) AS b, regr_intercept(xx, x) AS a, regr_slope(y, x) AS d, regr_intercept(y, x) AS c FROM fit GROUP BY h),
    q AS (SELECT h, regr_slope(y - (c + d * x), xx - (a + b * x)) AS k FROM fit JOIN lin USING (h) GROUP BY h)
    SELECT level, count(*) AS runs, round(sqrt(avg(pow(y - (c + d * x) - k * (x * x - a - b * x), 2))), 9) AS quadratic_rmse
    FROM s JOIN lin ON lin.h = level JOIN q ON q.h = level GROUP BY level""",
)
def _(spark, sf):
    out = audits.quadratic_holdout(spending(spark, sf), "c_acctbal", "transfer", "level")
    return rounded(out, "quadratic_rmse")


@query(
    "isotonic_holdout",
    """WITH runs AS (SELECT c_mktsegment AS level, c_acctbal AS x, coalesce(t, 0)::DOUBLE AS y FROM customer
      LEFT JOIN (SELECT o_custkey, count(*) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey),
    p AS (SELECT l.level, x, sum(y) AS s, count(*) AS n FROM runs JOIN (SELECT DISTINCT level FROM runs) l ON runs.level <> l.level GROUP BY ALL),
    c AS (SELECT *, row_number() OVER w AS i, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM p WINDOW w AS (PARTITION BY level ORDER BY x)),
    m AS (SELECT a.level, a.i, b.i AS k, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.level = b.level AND b.i >= a.i),
    lo AS (SELECT level, i, k, min(mean) OVER (PARTITION BY level, i ORDER BY k DESC) AS least FROM m),
    f AS (SELECT level, k AS i, max(least) AS v FROM lo GROUP BY ALL),
    fit AS (SELECT level, x, v, lead(x) OVER w AS x2, lead(v) OVER w AS v2, lag(x) OVER w AS x0 FROM f JOIN c USING (level, i) WINDOW w AS (PARTITION BY level ORDER BY x)),
    e AS (SELECT r.level, y, CASE WHEN fit.x IS NULL THEN (SELECT arg_min(v, x) FROM fit g WHERE g.level = r.level)
        WHEN x2 IS NULL OR v2 = v THEN v ELSE v + (v2 - v) * (r.x - fit.x) / (x2 - fit.x) END AS p
      FROM runs r ASOF LEFT JOIN fit ON r.level = fit.level AND r.x >= fit.x)
    SELECT level, count(*) AS runs, round(sqrt(avg((y - p) * (y - p))), 9) AS isotonic_rmse FROM e GROUP BY level""",
)
def _(spark, sf):
    rows = spending(spark, sf).withColumn("transfer", F.col("transfer").cast("double"))
    return rounded(audits.isotonic_holdout(rows, "c_acctbal", "transfer", "level"), "isotonic_rmse")


CONTEXT_SQL = f"""{RECORDINGS_SQL}, w AS (SELECT doc_id, subject_id, subject_id || '/' || lang AS recording_id FROM recordings),
  rec AS (SELECT subject_id, recording_id, count(*) AS m FROM w GROUP BY ALL),
  rec2 AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY subject_id ORDER BY md5('2-' || recording_id), recording_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM rec),
  sub AS (SELECT subject_id, sum(m)::BIGINT AS n FROM rec GROUP BY 1),
  sub2 AS (SELECT *, coalesce(sum(n) OVER (ORDER BY md5('2-' || subject_id), subject_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, sum(n) OVER ()::BIGINT AS total FROM sub),
  pl AS (SELECT w.*, m, a, n, s, total, row_number() OVER (PARTITION BY w.subject_id, w.recording_id
      ORDER BY md5('2-' || doc_id), doc_id) - 1 AS r, md5('2-' || doc_id || '-partner') AS k
    FROM w JOIN rec2 USING (subject_id, recording_id) JOIN sub2 USING (subject_id))"""


@query(
    "matched_contexts",
    f"""WITH {CONTEXT_SQL}, want AS (
      SELECT doc_id, 'same_recording' AS kind, s + a + (r + 1 + {word('k', 0)} % greatest(m - 1, 1)) % m AS p FROM pl WHERE m > 1
      UNION ALL SELECT doc_id, 'same_subject', s + (a + m + {word('k', 1)} % greatest(n - m, 1)) % n FROM pl WHERE n > m
      UNION ALL SELECT doc_id, 'cross_subject', (s + n + {word('k', 2)} % greatest(total - n, 1)) % total FROM pl WHERE total > n)
    SELECT want.doc_id, kind, pl.doc_id AS partner FROM want JOIN pl ON pl.s + pl.a + pl.r = p""",
)
def _(spark, sf):
    windows = views.recordings(spark, sf).select(
        "doc_id", "subject_id", F.concat_ws("/", "subject_id", "lang").alias("recording_id")
    )
    return contexts.matched_contexts(windows, "doc_id", seed=2)


@query(
    "period_estimate",
    f"""WITH {SERIES_SQL}, l AS (SELECT a.recording_id, b.frame_no - a.frame_no AS lag, count(*) AS pairs, corr(a.value, b.value) AS c
      FROM series a JOIN series b ON a.recording_id = b.recording_id AND b.frame_no - a.frame_no BETWEEN 2 AND 12 GROUP BY 1, 2)
    SELECT recording_id, arg_min(lag, (-round(c, 9), lag)) AS period FROM l WHERE pairs >= 3 AND c IS NOT NULL AND NOT isnan(c) GROUP BY 1""",
)
def _(spark, sf):
    lags = series.lag_statistics(series_frames(spark, sf), "value", 12).filter("lag >= 2")
    return series.period_estimate(lags)


def phased(spark, sf):
    frames = series_frames(spark, sf)
    periods = series.period_estimate(series.lag_statistics(frames, "value", 12).filter("lag >= 2"))
    return frames.join(periods, "recording_id").select(
        "event_id", "recording_id", F.col("frame_no").alias("window_start"), "period"
    )


PHASE_SQL = f"""{SERIES_SQL}, l AS (SELECT a.recording_id, b.frame_no - a.frame_no AS lag, count(*) AS pairs, corr(a.value, b.value) AS c
    FROM series a JOIN series b ON a.recording_id = b.recording_id AND b.frame_no - a.frame_no BETWEEN 2 AND 12 GROUP BY 1, 2),
  per AS (SELECT recording_id, arg_min(lag, (-round(c, 9), lag)) AS period FROM l WHERE pairs >= 3 AND c IS NOT NULL AND NOT isnan(c) GROUP BY 1),
  ph AS (SELECT event_id, recording_id, period, frame_no % period AS phase FROM series JOIN per USING (recording_id)),
  pos AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY phase, md5('6-' || event_id), event_id) - 1 AS p,
    count(*) OVER (PARTITION BY recording_id) AS n FROM ph),
  near AS (SELECT a.event_id, count(*) FILTER (least(abs(a.phase - b.phase), a.period - abs(a.phase - b.phase)) > 1) AS ok,
    count(*) FILTER (b.phase < (a.phase + 2) % a.period) AS start
    FROM ph a JOIN ph b USING (recording_id) GROUP BY 1),
  want AS (SELECT pos.*, (start + {word("md5('6-' || event_id || '-phase')")} % ok) % n AS t FROM pos JOIN near USING (event_id) WHERE ok > 0)"""


@query(
    "phase_filtered_contexts",
    f"""WITH {PHASE_SQL} SELECT w.event_id, w.recording_id, w.phase, w.period, q.event_id AS partner, q.phase AS partner_phase
    FROM want w JOIN pos q ON q.recording_id = w.recording_id AND q.p = w.t""",
)
def _(spark, sf):
    return contexts.phase_filtered_contexts(phased(spark, sf), "event_id", max_period=12, tolerance=1, seed=6)
