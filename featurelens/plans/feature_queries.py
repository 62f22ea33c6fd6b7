"""Pooling, moments, rank and variance-share queries over embeddings and order lines."""

from pyspark.sql import functions as F

from featurelens.functions import vectors as vec
from featurelens.functions.hashing import draw_below, seeded_key
from featurelens.operators import geometry_stats as geo
from featurelens.operators import moments, scoring, tiles
from featurelens.plans import views
from featurelens.plans.registry import query
from featurelens.plans.sqltext import splits_sql, word
from featurelens.operators.inventory import assign_splits
from featurelens.schemas import METADATA_COLUMNS
from featurelens.plans.views import ELEMENTS_SQL, FEATURES_SQL, LOSSES_SQL, RAGGED_SQL, TOKENS_SQL

GRID = 8


def rounded(df, *names, digits=9):
    """Round the named columns; a tiny negative becomes plain zero."""
    return df.select(
        *[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns]
    )


def long_form(df, keys, column="features"):
    """One row per vector element, rounded."""
    exploded = df.select(*keys, F.posexplode(column).alias("dim", "x"))
    return rounded(exploded.withColumn("dim", F.col("dim").cast("bigint")), "x")


# Exact traces of the balanced token grid.
TRACES_SQL = f"""{TOKENS_SQL},
grand AS (SELECT sum(m * m) AS mu FROM (SELECT avg(x) AS m FROM tokens GROUP BY dim)),
whole AS (SELECT sum(x * x) / count(DISTINCT (clip_id, pos)) AS q FROM tokens),
clip_level AS (SELECT sum(m * m) / count(DISTINCT clip_id) AS c, count(DISTINCT clip_id) AS clips
  FROM (SELECT clip_id, dim, avg(x) AS m FROM tokens GROUP BY clip_id, dim)),
pos_level AS (SELECT sum(m * m) / count(DISTINCT pos) AS p, count(DISTINCT pos) AS positions
  FROM (SELECT pos, dim, avg(x) AS m FROM tokens GROUP BY pos, dim)),
traces AS (SELECT clips, positions AS positions_per_clip, 8 AS dim, q - mu AS trace_total,
    c - mu AS trace_clip, p - mu AS trace_position, q - c AS trace_within,
    q - c - (p - mu) AS trace_residual
  FROM grand, whole, clip_level, pos_level)"""


@query(
    "position_share",
    f"""WITH {TRACES_SQL}
    SELECT clips, positions_per_clip, dim, round(trace_total, 9) AS trace_total,
      round(trace_clip, 9) AS trace_clip, round(trace_within, 9) AS trace_within,
      round(trace_position, 9) AS trace_position, round(trace_residual, 9) AS trace_residual,
      round(trace_clip / trace_total, 9) AS beta,
      round(trace_position / trace_within, 9) AS position_share_of_within,
      round(trace_residual / trace_within, 9) AS residual_share_of_within FROM traces""",
)
def _(spark, sf):
    out = geo.position_share(views.tokens(spark, sf), width=GRID)
    return rounded(out, *out.columns[3:])


@query(
    "leakage_floor",
    f"""WITH {TRACES_SQL}
    SELECT round(trace_within / 8, 9) AS naive_floor, round(trace_residual / 8, 9) AS corrected_floor,
      round(trace_clip / (trace_within / 8), 9) AS observed_over_naive,
      round(trace_clip / (trace_residual / 8), 9) AS observed_over_corrected FROM traces""",
)
def _(spark, sf):
    out = geo.leakage_floor(geo.position_share(views.tokens(spark, sf), width=GRID))
    names = ["naive_floor", "corrected_floor", "observed_over_naive", "observed_over_corrected"]
    return rounded(out.select(*names), *names)


@query(
    "dense_share",
    f"""WITH {TRACES_SQL}
    SELECT round(trace_clip / trace_total, 9) AS beta, round(trace_residual / trace_total, 9) AS gamma,
      round(trace_position / trace_total, 9) AS position_share FROM traces""",
)
def _(spark, sf):
    out = geo.dense_share(geo.position_share(views.tokens(spark, sf), width=GRID))
    return rounded(out.select("beta", "gamma", "position_share"), "beta", "gamma", "position_share")


@query(
    "position_share_by_label",
    f"""WITH {TOKENS_SQL},
    grand AS (SELECT label, sum(m * m) AS mu FROM (SELECT label, dim, avg(x) AS m FROM tokens GROUP BY ALL) GROUP BY label),
    whole AS (SELECT label, sum(x * x) / count(DISTINCT (clip_id, pos)) AS q FROM tokens GROUP BY label),
    c AS (SELECT label, sum(m * m) / count(DISTINCT clip_id) AS c, count(DISTINCT clip_id) AS clips
      FROM (SELECT label, clip_id, dim, avg(x) AS m FROM tokens GROUP BY ALL) GROUP BY label),
    p AS (SELECT label, sum(m * m) / 8 AS p FROM (SELECT label, pos, dim, avg(x) AS m FROM tokens GROUP BY ALL) GROUP BY label)
    SELECT label, clips, round(q - mu, 9) AS trace_total, round(c - mu, 9) AS trace_clip,
      round(p - mu, 9) AS trace_position, round(q - c - p + mu, 9) AS trace_residual
    FROM grand JOIN whole USING (label) JOIN c USING (label) JOIN p USING (label)""",
)
def _(spark, sf):
    out = geo.position_share(views.tokens(spark, sf), group=["label"], width=GRID)
    names = ["trace_total", "trace_clip", "trace_position", "trace_residual"]
    return rounded(out.select("label", "clips", *names), *names)


@query(
    "token_accumulators",
    f"""WITH {TOKENS_SQL}, s AS (
      SELECT 1 AS is_clip, clip_id AS id, dim, sum(x) AS s, count(*) AS n, sum(x * x) AS q FROM tokens GROUP BY clip_id, dim
      UNION ALL SELECT 0, pos, dim, sum(x), count(*), sum(x * x) FROM tokens GROUP BY pos, dim)
    SELECT is_clip, id, n AS tokens, dim, round(s, 9) AS x, round(sum(q) OVER (PARTITION BY is_clip, id), 9) AS squares FROM s""",
)
def _(spark, sf):
    acc = geo.token_accumulators(views.tokens(spark, sf), width=GRID)
    rows = acc.select(
        F.col("is_clip").cast("int").alias("is_clip"),
        F.coalesce("clip_id", "pos").alias("id"),
        "tokens",
        "total",
        "squares",
    )
    return rounded(long_form(rows, ["is_clip", "id", "tokens", "squares"], "total"), "squares")


WEIGHTED_SQL = f"""WITH {RAGGED_SQL},
  c AS (SELECT clip_id, count(*) AS n, sum(x0) AS s0, sum(x1) AS s1, sum(x0 * x0 + x1 * x1) AS q
    FROM ragged GROUP BY clip_id),
  w AS (SELECT count(*) AS clips, sum(n)::BIGINT AS tokens, min(n) AS min_tokens, max(n) AS max_tokens,
    sum(q) / sum(n) - (pow(sum(s0), 2) + pow(sum(s1), 2)) / pow(sum(n), 2) AS t,
    sum((s0 * s0 + s1 * s1) / n) / sum(n) - (pow(sum(s0), 2) + pow(sum(s1), 2)) / pow(sum(n), 2) AS b FROM c)
  SELECT clips, tokens, min_tokens, max_tokens, round(t, 4) AS trace_total, round(b, 4) AS trace_between,
    round(t - b, 4) AS trace_within, round(b / t, 9) AS beta FROM w"""


@query("weighted_shares", WEIGHTED_SQL)
def _(spark, sf):
    out = geo.weighted_shares(views.ragged(spark, sf), width=2)
    out = rounded(out, "trace_total", "trace_between", "trace_within", digits=4)
    return rounded(out, "beta")


@query(
    "between_within",
    f"""WITH {TRACES_SQL}
    SELECT clips, clips * 8 AS tokens, round(trace_total, 9) AS trace_total,
      round(trace_clip, 9) AS trace_between, round(trace_within, 9) AS trace_within,
      round(trace_clip / trace_total, 9) AS beta FROM traces""",
)
def _(spark, sf):
    out = geo.between_within(views.tokens(spark, sf), width=GRID)
    return rounded(out, "trace_total", "trace_between", "trace_within", "beta")


@query("variance_decomposition")
def _(spark, sf):
    return geo.variance_decomposition(views.tokens(spark, sf), width=GRID)


@query("effective_rank")
def _(spark, sf):
    stats = moments.spectral_stats(views.features(spark, sf))
    return stats.select("rows", "dimensions", "effective_rank")


@query(
    "feature_spread",
    f"""WITH {FEATURES_SQL}, {ELEMENTS_SQL}
    SELECT round(avg(s), 9) AS feature_std, round(sum(s * s), 9) AS trace
    FROM (SELECT dim, stddev_pop(x) AS s FROM elements GROUP BY dim)""",
)
def _(spark, sf):
    stats = moments.spectral_stats(views.features(spark, sf))
    return rounded(stats.select("feature_std", "trace"), "feature_std", "trace")


@query(
    "vicreg_stats",
    f"""WITH {FEATURES_SQL}, {ELEMENTS_SQL},
    m AS (SELECT label, dim, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM elements GROUP BY label, dim),
    z AS (SELECT e.vec_id, e.label, e.dim, e.x - m.m AS x FROM elements e JOIN m ON e.label = m.label AND e.dim = m.dim),
    c AS (SELECT a.label, a.dim AS i, b.dim AS j, sum(a.x * b.x) / (count(*) - 1) AS c
      FROM z a JOIN z b ON a.vec_id = b.vec_id AND a.dim <> b.dim GROUP BY ALL),
    h AS (SELECT label, avg(greatest(1 - sqrt(v + 1e-4::DOUBLE), 0)) AS vl FROM m GROUP BY label)
    SELECT label, round(vl, 9) AS variance_loss, round(sum(c * c) / 64, 9) AS covariance_loss
    FROM c JOIN h USING (label) GROUP BY label, vl""",
)
def _(spark, sf):
    stats = moments.spectral_stats(views.features(spark, sf), ["label"])
    names = ["variance_loss", "covariance_loss"]
    return rounded(stats.select("label", *names), *names)


@query(
    "covariance_matrix",
    f"""WITH {TOKENS_SQL}, pairs AS (
      SELECT a.dim AS i, b.dim AS j, covar_samp(a.x, b.x) AS c FROM tokens a
      JOIN tokens b ON a.clip_id = b.clip_id AND a.pos = b.pos GROUP BY a.dim, b.dim)
    SELECT i AS "row", j AS "column", round(c, 9) AS covariance FROM pairs""",
)
def _(spark, sf):
    return rounded(moments.covariance(views.tokens(spark, sf)), "covariance")


@query(
    "eigenvalue_sums",
    f"""WITH {TOKENS_SQL}, c AS (
      SELECT a.dim AS i, b.dim AS j, covar_pop(a.x, b.x) AS c FROM tokens a
      JOIN tokens b ON a.clip_id = b.clip_id AND a.pos = b.pos GROUP BY a.dim, b.dim)
    SELECT (SELECT round(sum(c), 9) FROM c WHERE i = j) AS trace,
      (SELECT round(sum(c * c), 9) FROM c) AS squares,
      (SELECT round(sum(x.c * y.c * z.c), 9) FROM c x JOIN c y ON x.j = y.i JOIN c z ON y.j = z.i AND z.j = x.i) AS cubes""",
)
def _(spark, sf):
    # Sums of powers of the eigenvalues are traces of powers of the matrix.
    stats = moments.spectral_stats(views.tokens(spark, sf))
    return rounded(stats.select("trace", "squares", "cubes"), "trace", "squares", "cubes")


WIDE_SQL = """wide AS (SELECT vec_id, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
  centred AS (SELECT vec_id, dim, x - avg(x) OVER (PARTITION BY dim) AS x FROM wide),
  c AS (SELECT a.dim AS i, b.dim AS j, sum(a.x * b.x) / (SELECT count(*) FROM embeddings) AS c
    FROM centred a JOIN centred b USING (vec_id) GROUP BY ALL)"""


@query(
    "tiled_power_sums",
    f"""WITH {WIDE_SQL} SELECT (SELECT round(sum(c), 9) FROM c WHERE i = j) AS trace,
      (SELECT round(sum(c * c), 9) FROM c) AS squares""",
)
def _(spark, sf):
    strips = tiles.tiled_covariance(views.features(spark, sf), tile=24)
    return rounded(tiles.power_sums(strips, tile=24), "trace", "squares")


@query("leading_spectrum")
def _(spark, sf):
    strips = tiles.tiled_covariance(views.features(spark, sf), tile=24)
    return tiles.leading_spectrum(strips, 4, tile=24)


@query("rank_report")
def _(spark, sf):
    tokens = views.tokens(spark, sf)
    control = tokens.withColumn(
        "features",
        F.transform(
            F.sequence(F.lit(0), F.lit(GRID - 1)),
            lambda k: draw_below(seeded_key(1, "clip_id", "pos", k), 1000) / 1000.0,
        ),
    )
    named = {}
    for model, rows in (("trained", tokens), ("control", control)):
        named[f"{model}/clip/pre"] = moments.pool_tokens(rows, ["clip_id"])
        named[f"{model}/token/pre"] = rows
        named[f"{model}/token/post"] = rows.withColumn("features", vec.layer_norm("features"))
    return geo.rank_report(named)


@query(
    "permutation_null",
    f"""WITH {TOKENS_SQL},
    cells AS (SELECT DISTINCT clip_id, pos FROM tokens),
    named AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY clip_id) AS k FROM cells),
    drawn AS (SELECT replicate, pos, clip_id AS clip, row_number() OVER (PARTITION BY replicate, pos
      ORDER BY md5('0-' || replicate || '-' || pos || '-' || clip_id), clip_id) AS k
      FROM cells, (SELECT unnest(range(4)) AS replicate)),
    moved AS (SELECT d.replicate, d.clip, dim, x
      FROM tokens JOIN named USING (clip_id, pos) JOIN drawn d USING (pos, k)),
    c AS (SELECT replicate, clip, dim, avg(x) AS m FROM moved GROUP BY ALL),
    b AS (SELECT replicate, sum(m * m) / count(DISTINCT clip) AS c FROM c GROUP BY replicate),
    t AS (SELECT sum(x * x) / count(DISTINCT (clip_id, pos)) AS q FROM tokens),
    g AS (SELECT sum(m * m) AS mu FROM (SELECT avg(x) AS m FROM tokens GROUP BY dim))
    SELECT replicate, round(c - mu, 9) AS trace_between, round((c - mu) / (q - mu), 9) AS beta FROM b, t, g""",
)
def _(spark, sf):
    out = geo.permutation_null(views.tokens(spark, sf), replicates=4, width=GRID)
    return rounded(out, "trace_between", "beta")


@query("population_stability")
def _(spark, sf):
    return geo.population_stability(views.tokens(spark, sf), [0.1, 0.3, 1.0], replicates=3, width=GRID)


@query(
    "population_stability_beta",
    f"""WITH {TOKENS_SQL},
    o AS (SELECT r, clip_id, row_number() OVER (PARTITION BY r ORDER BY md5('0-' || r || '-' || clip_id), clip_id) - 1 AS o,
      count(*) OVER (PARTITION BY r) AS n FROM (SELECT DISTINCT clip_id FROM tokens), (SELECT unnest(range(3)) AS r)),
    s AS (SELECT r, clip_id, greatest(2, round_even(f * n, 0))::BIGINT AS size FROM o,
      (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (1.0::DOUBLE)) f(f) WHERE o < greatest(2, round_even(f * n, 0))),
    e AS (SELECT r, size, clip_id, pos, dim, x FROM tokens JOIN s USING (clip_id)),
    g AS (SELECT r, size, sum(m * m) AS mu FROM (SELECT r, size, dim, avg(x) AS m FROM e GROUP BY ALL) GROUP BY ALL),
    q AS (SELECT r, size, sum(x * x) / max(8 * size) AS q FROM e GROUP BY r, size),
    c AS (SELECT r, size, sum(m * m) / max(size) AS c FROM (SELECT r, size, clip_id, dim, avg(x) AS m FROM e GROUP BY ALL) GROUP BY ALL)
    SELECT r AS replicate, size, round((c - mu) / (q - mu), 9) AS beta
    FROM g JOIN q USING (r, size) JOIN c USING (r, size)""",
)
def _(spark, sf):
    out = geo.population_stability(views.tokens(spark, sf), [0.1, 0.3, 1.0], replicates=3, width=GRID)
    return rounded(out.select("replicate", "size", "beta"), "beta")


@query(
    "dense_labels",
    """WITH v AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) AS rn,
      sum(n) OVER (PARTITION BY l_orderkey)::BIGINT AS pixels FROM v)
    SELECT l_orderkey, l_returnflag, pixels FROM r WHERE rn = 1""",
)
def _(spark, sf):
    return geo.dense_labels(views.table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag")


@query(
    "clip_mean_pool",
    f"WITH {TOKENS_SQL} SELECT clip_id, dim, round(avg(x), 9) AS x FROM tokens GROUP BY clip_id, dim",
)
def _(spark, sf):
    return long_form(moments.pool_tokens(views.tokens(spark, sf), ["clip_id"], GRID), ["clip_id"])


@query(
    "dimension_stats",
    f"""WITH {FEATURES_SQL}, {ELEMENTS_SQL}
    SELECT dim, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std FROM elements GROUP BY dim""",
)
def _(spark, sf):
    return rounded(moments.dimension_stats(views.features(spark, sf)), "mean", "std")


@query(
    "normalise_input",
    f"""WITH {FEATURES_SQL}, {ELEMENTS_SQL}
    SELECT vec_id, dim, round((x - 0.5) / 0.5, 9) AS x FROM elements""",
)
def _(spark, sf):
    rows = views.features(spark, sf)
    return long_form(rows.withColumn("features", vec.normalise_input("features")), ["vec_id"])


LAYER_SQL = f"""{TOKENS_SQL}, ln AS (
  SELECT clip_id, pos, dim, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5::DOUBLE) AS x
  FROM tokens WINDOW w AS (PARTITION BY clip_id, pos))"""


@query("layer_norm_tokens", f"WITH {LAYER_SQL} SELECT clip_id, pos, dim, round(x, 9) AS x FROM ln")
def _(spark, sf):
    normed = views.tokens(spark, sf).withColumn("features", vec.layer_norm("features"))
    return long_form(normed, ["clip_id", "pos"])


@query(
    "normalise_targets",
    f"""WITH {LAYER_SQL}, s AS (SELECT dim, avg(x) AS m, greatest(stddev_pop(x), 1e-4::DOUBLE) AS s FROM ln GROUP BY dim)
    SELECT clip_id, pos, dim, round((x - m) / s, 9) AS x FROM ln JOIN s USING (dim)""",
)
def _(spark, sf):
    normed = moments.normalise_targets(views.tokens(spark, sf))
    return long_form(normed, ["clip_id", "pos"])


@query(
    "standardise_by_label",
    f"""WITH {FEATURES_SQL}, {ELEMENTS_SQL}
    SELECT vec_id, dim, round((x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-4::DOUBLE), 9) AS x
    FROM elements WINDOW w AS (PARTITION BY label, dim)""",
)
def _(spark, sf):
    scaled = moments.standardise(views.features(spark, sf), group=["label"])
    return long_form(scaled, ["vec_id"])


@query(
    "sample_tokens",
    f"""WITH t AS (SELECT l_orderkey % 37 AS batch, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
    d AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY
      md5('9-' || batch || '-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey),
      l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS draw FROM t),
    k AS (SELECT *, row_number() OVER (ORDER BY batch, draw) - 1 AS place FROM d WHERE draw < 200)
    SELECT batch, l_orderkey, l_linenumber, l_partkey, draw FROM k WHERE place < 5000""",
)
def _(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 37).alias("batch"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return geo.sample_tokens(rows, "batch", keys, 200, 5000, seed=9).drop("l_suppkey")


@query(
    "example_means",
    f"""WITH {LOSSES_SQL}, g AS (SELECT sample_id, mask_group, avg(loss) AS v FROM losses GROUP BY ALL),
    e AS (SELECT sample_id, avg(v) AS v FROM g GROUP BY sample_id)
    SELECT round(avg(v), 9) AS mean_loss, count(*) AS examples FROM e""",
)
def _(spark, sf):
    return rounded(scoring.example_means(views.losses(spark, sf)), "mean_loss")


@query(
    "prefix_metrics",
    f"""WITH {LOSSES_SQL}, g AS (SELECT condition, sample_id, mask_group, avg(loss) AS v FROM losses GROUP BY ALL),
    e AS (SELECT condition, sample_id, avg(v) AS v FROM g GROUP BY ALL)
    SELECT condition, round(avg(v), 9) AS token_mean_loss, count(*) AS token_examples FROM e GROUP BY condition""",
)
def _(spark, sf):
    means = rounded(scoring.example_means(views.losses(spark, sf), by=["condition"]), "mean_loss")
    return scoring.prefix_metrics(means, "token", keep=["condition"])


@query(
    "evaluation_projection",
    f"""WITH {FEATURES_SQL}, {splits_sql('features', 0.4)}
    SELECT f.subject_id, split, speed AS gait_system, speed, clothing, direction, recording_id,
      source_video_id, window_start FROM features f JOIN slots USING (subject_id)""",
)
def _(spark, sf):
    rows = assign_splits(views.features(spark, sf), heldout=0.4)
    return rows.select(*METADATA_COLUMNS)


def masked_pairs(spark, sf):
    """A third of each clip's cells as targets; the prediction is the clip's mean token."""
    tokens = views.tokens(spark, sf).withColumnRenamed("clip_id", "sample_id")
    cells = tokens.select(
        "sample_id",
        F.col("pos").alias("cell"),
        (F.col("sample_id") % 2).alias("mask_group"),
    ).filter(draw_below(seeded_key(2, "sample_id", "cell"), 3) == 0)
    targets = scoring.gather_tokens(tokens, cells).withColumnRenamed("features", "target")
    means = moments.pool_tokens(tokens, ["sample_id"]).drop("tokens")
    return targets.join(means.withColumnRenamed("features", "predicted"), "sample_id")


PAIRS_SQL = f"""{TOKENS_SQL}, mean AS (SELECT clip_id, dim, avg(x) AS p FROM tokens GROUP BY ALL),
  pairs AS (SELECT t.clip_id AS sample_id, t.clip_id % 2 AS mask_group, pos, dim, x AS t, p
    FROM tokens t JOIN mean USING (clip_id, dim)
    WHERE {word("md5('2-' || t.clip_id || '-' || pos)")} % 3 = 0)"""


@query(
    "prediction_scores",
    f"""WITH {PAIRS_SQL}, s AS (SELECT sample_id, mask_group, pos, avg(pow(abs(p - t), 2) / 2) AS e,
      sum(p * t) / (sqrt(sum(p * p)) * sqrt(sum(t * t))) AS c FROM pairs GROUP BY ALL)
    SELECT sample_id, mask_group, round(avg(e), 9) AS loss, round(avg(c), 9) AS cosine, count(*) AS tokens
    FROM s GROUP BY sample_id, mask_group""",
)
def _(spark, sf):
    return rounded(scoring.prediction_scores(masked_pairs(spark, sf), 2.0), "loss", "cosine")


@query(
    "gather_tokens",
    f"""WITH {TOKENS_SQL} SELECT clip_id AS sample_id, clip_id % 2 AS mask_group, pos, dim, round(x, 9) AS x
    FROM tokens WHERE {word("md5('2-' || clip_id || '-' || pos)")} % 3 = 0""",
)
def _(spark, sf):
    tokens = views.tokens(spark, sf).withColumnRenamed("clip_id", "sample_id")
    cells = tokens.select(
        "sample_id", F.col("pos").alias("cell"), (F.col("sample_id") % 2).alias("mask_group")
    ).filter(draw_below(seeded_key(2, "sample_id", "cell"), 3) == 0)
    return long_form(scoring.gather_tokens(tokens, cells), ["sample_id", "mask_group", "pos"])
