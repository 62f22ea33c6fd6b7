"""Streaming jobs run to completion over the driver tables; results equal the batch SQL."""

from pyspark.sql import functions as F

from featurelens.plans import views
from featurelens.plans.feature_queries import TRACES_SQL, rounded
from featurelens.plans.registry import query
from featurelens.session import scratch_path
from featurelens.streaming import jobs


def landed(spark, df, name, files):
    """Write ``df`` as landing files and return their folder."""
    path = scratch_path(spark, name)
    df.repartition(files).write.parquet(path)
    return path


@query(
    "stream_position_share",
    f"""WITH {TRACES_SQL} SELECT clips, positions_per_clip, round(trace_total, 9) AS trace_total,
      round(trace_clip, 9) AS trace_clip, round(trace_position, 9) AS trace_position,
      round(trace_residual, 9) AS trace_residual FROM traces""",
)
def _(spark, sf):
    tokens = views.tokens(spark, sf)
    path = landed(spark, tokens, "tokens", 4)
    stream = jobs.landing_stream(spark, path, tokens.schema, files_per_batch=1)
    state = scratch_path(spark, "shares")
    jobs.accumulate_tokens(stream, state, scratch_path(spark, "offsets")).awaitTermination()
    out = jobs.merged_shares(spark, state)
    names = ["trace_total", "trace_clip", "trace_position", "trace_residual"]
    return rounded(out.select("clips", "positions_per_clip", *names), *names)


@query(
    "stream_collapse_monitor",
    """WITH e AS (SELECT event_type, value / 100 AS a, CAST(user_id AS DOUBLE) / 50 AS b,
      floor(epoch(ts) / 21600)::BIGINT * 21600 AS w FROM events),
    closed AS (SELECT * FROM e WHERE w + 21600 <= (SELECT max(epoch(ts)) - 3600 FROM events)),
    c AS (SELECT w, event_type, count(*) AS n, sum(a) AS sa, sum(b) AS sb FROM closed GROUP BY ALL),
    t AS (SELECT w, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb FROM closed GROUP BY w),
    k AS (SELECT w, count(*) AS clips, sum((sa * sa + sb * sb) / n) AS q FROM c GROUP BY w)
    SELECT w AS window_start, n AS "rows", clips, round((sqrt(va) + sqrt(vb)) / 2, 9) AS feature_std,
      round((q / n - ma * ma - mb * mb) / (va + vb), 9) AS beta FROM t JOIN k USING (w)""",
)
def _(spark, sf):
    rows = views.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("clip_id"),
        F.array(F.col("value") / 100, F.col("user_id").cast("double") / 50).alias("features"),
    )
    path = landed(spark, rows, "arrivals", 3)
    stream = jobs.landing_stream(spark, path, rows.schema)
    out = scratch_path(spark, "collapse")
    jobs.monitor_collapse(stream, "ts", "6 hours", "1 hour", out, scratch_path(spark, "offsets")).awaitTermination()
    back = spark.read.schema(
        "window_start timestamp, rows bigint, clips bigint, feature_std double, beta double"
    ).parquet(out)
    stamped = back.withColumn("window_start", F.unix_timestamp("window_start"))
    return rounded(stamped, "feature_std", "beta")


@query(
    "stream_running_best",
    """WITH h AS (SELECT event_type AS run_id, CAST(day(ts) AS BIGINT) AS epoch, avg(value) AS loss FROM events GROUP BY ALL)
    SELECT run_id, arg_min(epoch, (loss, epoch)) AS best_epoch, round(min(loss), 9) AS best_loss FROM h GROUP BY run_id""",
)
def _(spark, sf):
    events = views.table(spark, sf, "events")
    rows = events.groupBy(
        F.col("event_type").alias("run_id"), F.dayofmonth("ts").cast("bigint").alias("epoch")
    ).agg(F.avg("value").alias("loss"))
    path = landed(spark, rows, "metrics", 3)
    stream = jobs.landing_stream(spark, path, rows.schema, files_per_batch=1)
    out = scratch_path(spark, "best")
    jobs.track_best(stream, out, scratch_path(spark, "offsets")).awaitTermination()
    return rounded(jobs.current_best(spark, out), "best_loss")
