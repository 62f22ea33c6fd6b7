"""Probe, hold-out, matching and scoring queries."""

from pyspark.sql import functions as F

from featurelens.functions import vectors as vec
from featurelens.functions.hashing import draw_below, draw_uniform, seeded_key
from featurelens.functions.ranking import sorted_index
from featurelens.operators import probes, series
from featurelens.operators.inventory import assign_splits
from featurelens.plans import views
from featurelens.plans.feature_queries import rounded
from featurelens.plans.registry import query
from featurelens.plans.sqltext import splits_sql, uniform, word
from featurelens.plans.views import FEATURES_SQL, LOSSES_SQL
from featurelens.session import materialise

HOLDOUT_SQL = f"""{FEATURES_SQL},
  src AS (SELECT subject_id, source_video_id, row_number() OVER (PARTITION BY subject_id
      ORDER BY md5('3-' || subject_id || '-' || source_video_id), source_video_id) - 1 AS slot,
    count(*) OVER (PARTITION BY subject_id) AS n
    FROM (SELECT DISTINCT subject_id, source_video_id FROM features)),
  held AS (SELECT subject_id, source_video_id FROM src WHERE slot < greatest(1, n // 4))"""


@query("source_holdout", f"WITH {HOLDOUT_SQL} SELECT subject_id, source_video_id FROM held")
def _(spark, sf):
    return probes.source_holdout(views.features(spark, sf), seed=3)


@query(
    "holdout_membership",
    f"""WITH {HOLDOUT_SQL}
    SELECT vec_id, subject_id, CASE WHEN source_video_id IN (SELECT source_video_id FROM held)
      THEN 'val' ELSE 'train' END AS part FROM features""",
)
def _(spark, sf):
    rows = views.features(spark, sf)
    train, held = probes.split_by_source(rows, probes.source_holdout(rows, seed=3))
    parts = train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("val")))
    return parts.select("vec_id", "subject_id", "part")


@query(
    "class_weights",
    """SELECT lang AS label, count(*) AS examples,
      round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * count(*))::DOUBLE, 9) AS weight
    FROM documents GROUP BY lang""",
)
def _(spark, sf):
    rows = views.table(spark, sf, "documents").select(F.col("lang").alias("label"))
    return rounded(probes.balanced_weights(rows, "label"), "weight")


@query(
    "class_counts",
    """SELECT count(DISTINCT label) AS classes, count(*) AS examples,
      round((SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) / count(*)::DOUBLE, 9) AS majority_share
    FROM embeddings""",
)
def _(spark, sf):
    counts = probes.balanced_weights(views.features(spark, sf), "subject_id")
    out = counts.agg(
        F.count(F.lit(1)).alias("classes"),
        F.sum("examples").alias("examples"),
        (F.max("examples") / F.sum("examples")).alias("majority_share"),
    )
    return rounded(out, "majority_share")


def split_features(spark, sf, heldout=0.4):
    """Features with splits, written once as an exported feature table would be."""
    return materialise(assign_splits(views.features(spark, sf), heldout=heldout))


@query("probe_condition")
def _(spark, sf):
    return probes.probe_condition(split_features(spark, sf))


@query("probe_identity")
def _(spark, sf):
    return probes.probe_identity(split_features(spark, sf), seed=3)


@query("probe_predictions")
def _(spark, sf):
    table = split_features(spark, sf)
    predict = probes.fit_probe(table.filter("split = 'train'"), "gait_system")
    return predict(table.filter("split = 'test'")).select("vec_id", "gait_system", "prediction")


GUESS_SQL = f"""guesses AS (SELECT doc_id, source, lang, n_chars,
  CASE WHEN {word("md5('5-' || doc_id)")} % 4 = 0 THEN 'en' WHEN n_chars % 13 = 0 THEN 'it' ELSE lang END AS prediction
  FROM documents)"""

SCORES_SQL = """conf AS (SELECT truth, guess, count(*) AS n FROM pairs GROUP BY ALL),
  names AS (SELECT DISTINCT truth AS name FROM conf UNION SELECT DISTINCT guess FROM conf),
  cls AS (SELECT name, coalesce((SELECT sum(n) FROM conf WHERE truth = name), 0) AS t,
    coalesce((SELECT sum(n) FROM conf WHERE guess = name), 0) AS g,
    coalesce((SELECT sum(n) FROM conf WHERE truth = name AND guess = name), 0) AS h FROM names),
  scores AS (SELECT sum(t)::BIGINT AS val_examples, count(*) FILTER (t > 0) AS num_classes,
    round(max(t) / sum(t), 9) AS majority_baseline, round(sum(h) / sum(t), 9) AS accuracy,
    round(avg(h / t) FILTER (t > 0), 9) AS balanced_accuracy, round(avg(2 * h / (t + g)), 9) AS macro_f1
  FROM cls)"""

SCORE_NAMES = ["majority_baseline", "accuracy", "balanced_accuracy", "macro_f1"]


def guesses(spark, sf):
    draw = draw_below(seeded_key(5, "doc_id"), 4)
    return views.table(spark, sf, "documents").select(
        "doc_id",
        "source",
        "lang",
        "n_chars",
        F.when(draw == 0, "en").when(F.col("n_chars") % 13 == 0, "it").otherwise(F.col("lang")).alias("prediction"),
    )


@query(
    "classification_metrics",
    f"""WITH {GUESS_SQL}, pairs AS (SELECT lang AS truth, prediction AS guess FROM guesses WHERE doc_id % 3 > 0), {SCORES_SQL}
    SELECT 'rule' AS model, 'lang' AS task, (SELECT count(*) FROM guesses WHERE doc_id % 3 = 0) AS train_examples, *
    FROM scores""",
)
def _(spark, sf):
    rows = guesses(spark, sf)
    scores = probes.classification_metrics(
        rows.filter("doc_id % 3 > 0"), "lang", "lang", rows.filter("doc_id % 3 = 0"), "rule"
    )
    return rounded(scores, *SCORE_NAMES)


@query(
    "exposure_ledger",
    f"""WITH {GUESS_SQL} SELECT count(*) AS "rows", count(DISTINCT source || '/' || n_chars % 50) AS recordings,
      count(DISTINCT source) AS subjects, count(DISTINCT lang) AS labels, count(DISTINCT prediction) AS predicted_labels,
      round(avg((lang = prediction)::INTEGER), 9) AS accuracy FROM guesses""",
)
def _(spark, sf):
    rows = guesses(spark, sf).select(
        F.col("source").alias("subject_id"),
        F.concat_ws("/", "source", (F.col("n_chars") % 50).cast("string")).alias("recording_id"),
        "lang",
        "prediction",
    )
    return rounded(probes.exposure_ledger(rows, "lang"), "accuracy")


@query(
    "roll_up",
    f"""WITH {LOSSES_SQL}, w AS (SELECT subject_id, subject_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS recording_id,
      CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS label, CASE WHEN event_id % 3 = 0 THEN 'A' ELSE 'B' END AS p FROM losses),
    v AS (SELECT subject_id, recording_id, label, p, count(*) AS n FROM w GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, p) AS rn,
      sum(n) OVER (PARTITION BY recording_id) AS windows FROM v)
    SELECT subject_id, count(*) AS recordings, sum(windows)::BIGINT AS windows, round(avg((label = p)::INTEGER), 9) AS accuracy
    FROM r WHERE rn = 1 GROUP BY subject_id""",
)
def _(spark, sf):
    rows = views.losses(spark, sf).select(
        "subject_id",
        F.concat_ws("/", "subject_id", F.to_date("ts").cast("string")).alias("recording_id"),
        F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("label"),
        F.when(F.col("event_id") % 3 == 0, "A").otherwise("B").alias("prediction"),
    )
    return rounded(probes.roll_up(rows, "label"), "accuracy")


CUT_SQL = f"""{LOSSES_SQL},
  fit AS (SELECT loss AS v, sum((condition = 'click')::INTEGER) AS lo, sum((condition = 'purchase')::INTEGER) AS hi
    FROM losses WHERE condition IN ('click', 'purchase') AND user_id % 2 = 0 GROUP BY loss),
  run AS (SELECT v, coalesce(sum(lo) OVER b, 0) AS lob, coalesce(sum(hi) OVER b, 0) AS hib,
    lag(v) OVER (ORDER BY v) AS e, sum(lo) OVER () AS l, sum(hi) OVER () AS h FROM fit
    WINDOW b AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  cuts AS (SELECT coalesce((e + v) / 2, v) AS cut, lob + h - hib AS correct, l + h AS n FROM run
    UNION ALL SELECT max(v) + 1, sum(lo), sum(lo) + sum(hi) FROM fit),
  best AS (SELECT * FROM cuts ORDER BY correct DESC, cut LIMIT 1)"""


def clicks(spark, sf):
    return views.losses(spark, sf).filter(F.col("condition").isin("click", "purchase"))


def fitted_cut(spark, sf):
    train = clicks(spark, sf).filter("user_id % 2 = 0")
    return probes.threshold_probe(train, "loss", "condition", "click", "purchase")


@query(
    "threshold_probe",
    f"""WITH {CUT_SQL} SELECT round(cut, 9) AS cut, correct::BIGINT AS correct,
      round(correct / n::DOUBLE, 9) AS train_accuracy FROM best""",
)
def _(spark, sf):
    return rounded(fitted_cut(spark, sf), "cut", "train_accuracy")


@query(
    "threshold_probe_test",
    f"""WITH {CUT_SQL}, pairs AS (SELECT condition AS truth, CASE WHEN loss < cut THEN 'click' ELSE 'purchase' END AS guess
      FROM losses, best WHERE condition IN ('click', 'purchase') AND user_id % 2 = 1), {SCORES_SQL}
    SELECT 'stopwatch' AS model, 'condition' AS task, (SELECT sum(lo + hi)::BIGINT FROM fit) AS train_examples, * FROM scores""",
)
def _(spark, sf):
    rows = clicks(spark, sf)
    train, test = rows.filter("user_id % 2 = 0"), rows.filter("user_id % 2 = 1")
    scored = probes.apply_threshold(test, fitted_cut(spark, sf), "loss", "click", "purchase")
    return rounded(
        probes.classification_metrics(scored, "condition", "condition", train, "stopwatch"), *SCORE_NAMES
    )


MATCH_SQL = """binned AS (SELECT *, floor(loss / 5.0::DOUBLE)::BIGINT AS bin FROM losses
    WHERE condition IN ('click', 'purchase') AND user_id % 2 = 1),
  keep AS (SELECT bin, least(count(*) FILTER (condition = 'click'), count(*) FILTER (condition = 'purchase')) AS k
    FROM binned GROUP BY bin),
  slots AS (SELECT *, row_number() OVER (PARTITION BY bin, condition ORDER BY md5('4-' || event_id), event_id) - 1 AS slot FROM binned),
  matched AS (SELECT s.* FROM slots s JOIN keep USING (bin) WHERE slot < k)"""


def matched(spark, sf):
    held = clicks(spark, sf).filter("user_id % 2 = 1")
    return probes.matched_subset(held, "loss", "condition", ["click", "purchase"], "event_id", 5.0, seed=4)


@query(
    "matched_subset",
    f"WITH {LOSSES_SQL}, {MATCH_SQL} SELECT event_id, bin, condition FROM matched",
)
def _(spark, sf):
    return matched(spark, sf).select("event_id", "bin", "condition")


@query(
    "matched_rescore",
    f"""WITH {CUT_SQL}, {MATCH_SQL}, pairs AS (SELECT condition AS truth,
      CASE WHEN loss < cut THEN 'click' ELSE 'purchase' END AS guess FROM matched, best), {SCORES_SQL}
    SELECT 'stopwatch' AS model, 'matched' AS task, (SELECT sum(lo + hi)::BIGINT FROM fit) AS train_examples, * FROM scores""",
)
def _(spark, sf):
    train = clicks(spark, sf).filter("user_id % 2 = 0")
    scored = probes.apply_threshold(matched(spark, sf), fitted_cut(spark, sf), "loss", "click", "purchase")
    return rounded(
        probes.classification_metrics(scored, "condition", "matched", train, "stopwatch"), *SCORE_NAMES
    )


def handcrafted(spark, sf):
    """Per user and condition: the spread of the values and their drift over time."""
    seconds = F.unix_timestamp("ts")
    rows = clicks(spark, sf).groupBy("user_id", "condition").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("loss").alias("mean"),
        F.stddev_pop("loss").alias("std"),
        F.max("loss").alias("max"),
        F.coalesce(F.covar_pop("loss", seconds) / F.greatest(F.var_pop(seconds), F.lit(1e-9)), F.lit(0.0)).alias("drift"),
    )
    return rows.select(
        "user_id",
        "condition",
        F.when(F.col("user_id") % 5 < 3, "train").otherwise("test").alias("split"),
        F.array("n", "mean", "std", "max", "drift").alias("features"),
    )


@query("shortcut_probes")
def _(spark, sf):
    rows = handcrafted(spark, sf)
    tables = {
        "all": rows,
        "mean_only": rows.withColumn("features", F.slice("features", 2, 1)),
        "spread_only": rows.withColumn("features", F.slice("features", 3, 2)),
    }
    return probes.run_probes(tables, [lambda t, m: probes.probe_condition(t, "condition", model=m)])


RETRIEVAL_SQL = f"""{FEATURES_SQL},
  rec AS (SELECT DISTINCT subject_id, recording_id FROM features),
  pick AS (SELECT subject_id, recording_id FROM (SELECT *, row_number() OVER (PARTITION BY subject_id
    ORDER BY md5('0-' || recording_id), recording_id) AS rn FROM rec) WHERE rn = 1),
  el AS (SELECT f.vec_id, f.subject_id, f.recording_id, u.i, CAST(f.features[u.i] AS DOUBLE) AS x
    FROM features f, (SELECT unnest(range(1, 65)) AS i) u),
  gal AS (SELECT el.subject_id AS name, i, avg(x) AS c FROM el JOIN pick USING (subject_id, recording_id) GROUP BY ALL),
  size AS (SELECT name, sqrt(sum(c * c)) AS s FROM gal GROUP BY name),
  sim AS (SELECT e.vec_id, e.subject_id, g.name, sum(e.x * g.c / s.s) AS d FROM el e
    ANTI JOIN pick p ON e.subject_id = p.subject_id AND e.recording_id = p.recording_id
    JOIN gal g ON g.i = e.i JOIN size s ON s.name = g.name GROUP BY ALL),
  matches AS (SELECT vec_id, subject_id, max_by(name, d) AS prediction,
    count(*) FILTER (d > own) + 1 AS true_rank
    FROM (SELECT *, max(d) FILTER (name = subject_id) OVER (PARTITION BY vec_id) AS own FROM sim) GROUP BY ALL)"""


@query(
    "heldout_retrieval",
    f"WITH {RETRIEVAL_SQL} SELECT vec_id, subject_id, prediction, true_rank FROM matches",
)
def _(spark, sf):
    return probes.heldout_retrieval(views.features(spark, sf))


@query(
    "retrieval_score",
    f"""WITH {RETRIEVAL_SQL} SELECT count(*) AS queries, round(avg((prediction = subject_id)::INTEGER), 9) AS top1,
      round(avg(true_rank), 9) AS mean_rank, round(1.0::DOUBLE / (SELECT count(DISTINCT label) FROM embeddings), 9) AS chance FROM matches""",
)
def _(spark, sf):
    rows = views.features(spark, sf)
    identities = rows.select("subject_id").distinct().count()
    score = probes.retrieval_score(probes.heldout_retrieval(rows), "subject_id", identities)
    return rounded(score, "top1", "mean_rank", "chance")


BASE_SQL = """tr AS (SELECT turn, role, count(*) AS n FROM conversations WHERE conv_id % 3 > 0 GROUP BY ALL),
  modes AS (SELECT turn, role AS mode FROM (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY n DESC, role) AS rn FROM tr) WHERE rn = 1),
  overall AS (SELECT role AS o FROM (SELECT role, sum(n) AS n FROM tr GROUP BY role) ORDER BY n DESC, role LIMIT 1),
  test AS (SELECT conv_id, c.turn, role, coalesce(mode, o) AS prediction FROM conversations c LEFT JOIN modes m ON c.turn = m.turn, overall WHERE conv_id % 3 = 0)"""


def position_predictions(spark, sf):
    rows = views.table(spark, sf, "conversations")
    return probes.position_baseline(
        rows.filter("conv_id % 3 > 0"), rows.filter("conv_id % 3 = 0"), ["turn"], "role"
    )


@query("position_baseline", f"WITH {BASE_SQL} SELECT conv_id, turn, role, prediction FROM test")
def _(spark, sf):
    return position_predictions(spark, sf).select("conv_id", "turn", "role", "prediction")


@query(
    "accuracy_gain",
    f"""WITH {BASE_SQL}, p AS (SELECT *, CASE WHEN length(text) % 9 = 0 THEN 'system' WHEN length(text) < 200 THEN 'user' ELSE 'assistant' END AS probe
      FROM test JOIN conversations c USING (conv_id, turn, role)),
    a AS (SELECT avg((role = prediction)::INTEGER) AS b, avg((role = probe)::INTEGER) AS p FROM p)
    SELECT round(b, 9) AS baseline_accuracy, round(p, 9) AS probe_accuracy, round(p - b, 9) AS gain FROM a""",
)
def _(spark, sf):
    size = F.length("text")
    probe = F.when(size % 9 == 0, "system").when(size < 200, "user").otherwise("assistant")
    rows = position_predictions(spark, sf).withColumn("probe", probe)
    out = probes.accuracy_gain(rows, "role", "prediction", "probe")
    return rounded(out, "baseline_accuracy", "probe_accuracy", "gain")


LANGS = ["de", "en", "es", "fr"]
RANKING_SQL = f"""s AS (SELECT doc_id, lang, l, {uniform("md5('6-' || doc_id || '-' || l)")} + CASE WHEN l = lang THEN 0.4::DOUBLE ELSE 0 END AS s
    FROM documents, (VALUES ('de'), ('en'), ('es'), ('fr')) t(l)),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, l) AS rn FROM s)"""


def rankings(spark, sf):
    score = lambda l: draw_uniform(seeded_key(6, F.col("doc_id"), F.lit(l))) + F.when(F.col("lang") == l, 0.4).otherwise(0.0)
    listed = F.array(*[F.struct((-score(l)).alias("s"), F.lit(l).alias("l")) for l in LANGS])
    rows = views.table(spark, sf, "documents").select("doc_id", "lang", F.array_sort(listed).alias("_r"))
    return rows.select("doc_id", "lang", F.col("_r.l").alias("ranking"))


@query(
    "top_k_scores",
    f"""WITH {RANKING_SQL}, h AS (SELECT lang, rn FROM r WHERE l = lang)
    SELECT count(*) AS examples, round(avg((rn <= 1)::INTEGER), 9) AS top1, round(avg((rn <= 2)::INTEGER), 9) AS top2,
      (SELECT round(avg(a), 9) FROM (SELECT avg((rn <= 1)::INTEGER) AS a FROM h GROUP BY lang)) AS macro_accuracy FROM h""",
)
def _(spark, sf):
    return rounded(probes.top_k_scores(rankings(spark, sf), "lang", (1, 2)), "top1", "top2", "macro_accuracy")


@query(
    "pair_accuracy",
    f"""WITH {RANKING_SQL}, p AS (SELECT * FROM (VALUES ('de', 'en'), ('es', 'fr'), ('en', 'fr')) t(a, b))
    SELECT a AS first_label, b AS second_label, count(*) AS examples, round(avg((o.rn < x.rn)::INTEGER), 9) AS accuracy
    FROM p JOIN r o ON o.l = o.lang AND o.lang IN (a, b)
    JOIN r x ON x.doc_id = o.doc_id AND x.l = CASE WHEN o.lang = a THEN b ELSE a END GROUP BY a, b""",
)
def _(spark, sf):
    pairs = [("de", "en"), ("es", "fr"), ("en", "fr")]
    return rounded(probes.pair_accuracy(rankings(spark, sf), "lang", pairs), "accuracy")


@query("information_gain")
def _(spark, sf):
    docs = views.table(spark, sf, "documents").join(views.table(spark, sf, "labels"), "doc_id")
    words = F.size(F.split("text", " "))
    rows = docs.select(
        "doc_id",
        F.col("quality").cast("string").alias("label"),
        F.array(F.log1p("n_chars"), (F.col("lang") == "en").cast("double")).alias("metadata"),
        F.array(
            words / F.greatest(F.col("n_chars"), F.lit(1)),
            (F.size(F.array_distinct(F.split("text", " "))) / words),
            (F.length("text") - F.length(F.regexp_replace("text", "[^A-Za-z]", ""))) / F.greatest(F.col("n_chars"), F.lit(1)),
        ).alias("extra"),
    )
    part = draw_below(seeded_key(0, "doc_id"), 3)
    return probes.information_gain(rows.filter(part > 0), rows.filter(part == 0), "label", "metadata", "extra")


HISTORY_SQL = """history AS (SELECT event_type AS run_id, CAST(day(ts) AS BIGINT) AS epoch, avg(value) AS loss FROM events GROUP BY ALL)"""


def history(spark, sf):
    events = views.table(spark, sf, "events")
    return events.groupBy(
        F.col("event_type").alias("run_id"), F.dayofmonth("ts").cast("bigint").alias("epoch")
    ).agg(F.avg("value").alias("loss"))


@query(
    "best_checkpoint",
    f"""WITH {HISTORY_SQL} SELECT run_id, arg_min(epoch, (loss, epoch)) AS best_epoch, round(min(loss), 9) AS best_loss,
      max(epoch) AS last_epoch FROM history GROUP BY run_id""",
)
def _(spark, sf):
    return rounded(probes.best_checkpoint(history(spark, sf)), "best_loss")


RUNS_SQL = """runs AS (SELECT n_nationkey AS run_id, c.metric, c.spread, s.transfer FROM nation
    JOIN (SELECT c_nationkey, avg(c_acctbal) AS metric, stddev_samp(c_acctbal) AS spread FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
    JOIN (SELECT s_nationkey, avg(s_acctbal) AS transfer FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey)"""


def runs(spark, sf):
    customers = views.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("run_id")).agg(
        F.avg("c_acctbal").alias("metric"), F.stddev_samp("c_acctbal").alias("spread")
    )
    suppliers = views.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("run_id")).agg(
        F.avg("s_acctbal").alias("transfer")
    )
    nations = views.table(spark, sf, "nation").select(F.col("n_nationkey").alias("run_id"))
    return nations.join(customers, "run_id").join(suppliers, "run_id")


@query(
    "selection_regret",
    f"""WITH {RUNS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY metric DESC, run_id) AS rn FROM runs)
    SELECT round(max(transfer), 9) AS oracle, round(max(transfer) - max(transfer) FILTER (rn <= 1), 9) AS regret_top1,
      round(max(transfer) - max(transfer) FILTER (rn <= 10), 9) AS regret_top10 FROM r""",
)
def _(spark, sf):
    return rounded(probes.selection_regret(runs(spark, sf), "metric", "transfer"), "oracle", "regret_top1", "regret_top10")


SERIES_SQL = """series AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no,
  event_id, value, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def series_frames(spark, sf):
    rows = views.table(spark, sf, "events").select(F.col("user_id").alias("recording_id"), "ts", "event_id", "value")
    return sorted_index(rows, ["recording_id"], [F.col("ts"), F.col("event_id")], out="frame_no")


@query(
    "signal_spectrum",
    f"""WITH {SERIES_SQL} SELECT recording_id, b AS bin, n AS frames,
      round((pow(sum(value * cos(2 * pi() * b * frame_no / n)), 2) + pow(sum(value * sin(2 * pi() * b * frame_no / n)), 2)) / n, 4) AS power
    FROM series, (SELECT unnest(range(1, 5)) AS b) GROUP BY recording_id, b, n""",
)
def _(spark, sf):
    return rounded(series.spectrum(series_frames(spark, sf), "value", 4), "power", digits=4)


@query(
    "lag_statistics",
    f"""WITH {SERIES_SQL} SELECT a.recording_id, b.frame_no - a.frame_no AS lag, count(*) AS pairs,
      round(corr(a.value, b.value), 9) AS autocorrelation, round(avg(abs(b.value - a.value)), 9) AS mean_change
    FROM series a JOIN series b ON a.recording_id = b.recording_id AND b.frame_no - a.frame_no BETWEEN 1 AND 4 GROUP BY 1, 2""",
)
def _(spark, sf):
    out = series.lag_statistics(series_frames(spark, sf), "value", 4)
    return rounded(rounded(out, "autocorrelation"), "mean_change", digits=9)


BAND_SQL = """frames AS (SELECT vec_id // 25 AS recording_id, vec_id % 25 AS frame_no, embedding::DOUBLE[] AS x FROM embeddings),
  band AS (SELECT a.recording_id, a.frame_no, (b.frame_no - a.frame_no)::INTEGER AS lag, list_cosine_similarity(a.x, b.x) AS similarity
    FROM frames a JOIN frames b ON a.recording_id = b.recording_id AND b.frame_no - a.frame_no BETWEEN 1 AND 6)"""


def vector_frames(spark, sf):
    """Every 25 vectors as the frames of a recording."""
    return views.table(spark, sf, "embeddings").select(
        F.expr("vec_id div 25").alias("recording_id"), (F.col("vec_id") % 25).alias("frame_no"), "embedding"
    )


@query(
    "self_similarity_band",
    f"WITH {BAND_SQL} SELECT recording_id, frame_no, lag, round(similarity, 9) AS similarity FROM band",
)
def _(spark, sf):
    return rounded(series.self_similarity(vector_frames(spark, sf), "embedding", 6), "similarity")


@query(
    "similarity_profile",
    f"""WITH {BAND_SQL} SELECT recording_id, lag, count(*) AS pairs, round(avg(similarity), 9) AS mean_similarity,
      round(stddev_pop(similarity), 9) AS spread FROM band GROUP BY recording_id, lag""",
)
def _(spark, sf):
    band = series.self_similarity(vector_frames(spark, sf), "embedding", 6)
    return rounded(series.similarity_profile(band), "mean_similarity", "spread")


@query("classical_baselines")
def _(spark, sf):
    """Spectrum and autocorrelation of each signal as probe features."""
    frames = series_frames(spark, sf)
    power = series.spectrum(frames, "value", 4).groupBy("recording_id").pivot("bin", [1, 2, 3, 4]).agg(F.first("power"))
    lags = series.lag_statistics(frames, "value", 4).groupBy("recording_id").pivot("lag", [1, 2, 3, 4]).agg(
        F.first("autocorrelation").alias("r"), F.first("mean_change").alias("c")
    )
    joined = power.join(lags, "recording_id")
    # A lag without spread has no correlation.
    known = {c: F.nanvl(F.col(f"`{c}`"), F.lit(0.0)) if c.endswith("_r") else F.col(f"`{c}`") for c in joined.columns}
    columns = [F.coalesce(known[c], F.lit(0.0)) for c in joined.columns if c != "recording_id"]
    rows = joined.select(
        F.when(F.col("recording_id") % 2 == 0, "even").otherwise("odd").alias("parity"),
        F.when(F.floor(F.col("recording_id") / 2) % 3 > 0, "train").otherwise("test").alias("split"),
        F.array(*columns).alias("features"),
    )
    return probes.probe_condition(rows, "parity", model="classical")
