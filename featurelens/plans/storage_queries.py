"""Write-and-read-back queries; files go below the shared scratch folder."""

from pyspark.sql import functions as F

from featurelens.operators.inventory import assign_splits
from featurelens.operators.moments import pool_tokens
from featurelens.plans import views
from featurelens.plans.feature_queries import TRACES_SQL, long_form, rounded
from featurelens.plans.probe_queries import GUESS_SQL, SCORE_NAMES, SCORES_SQL, guesses
from featurelens.operators import geometry_stats as geo
from featurelens.operators import probes
from featurelens.plans.registry import query
from featurelens.plans.sqltext import splits_sql, word
from featurelens.plans.views import FEATURES_SQL, PIXELS_SQL, RECORDINGS_SQL, TURNS_SQL
from featurelens.session import scratch_path
from featurelens.sources import frames as files
from featurelens.sources import tables

MANIFEST_SQL = f"""WITH {RECORDINGS_SQL}, {splits_sql('recordings', 0.2)}
  SELECT subject_id, split, 'data/raw/' || recording_id AS frame_dir, num_frames, speed AS gait_system, speed,
    clothing, direction, recording_id, source_video_id FROM recordings JOIN slots USING (subject_id)"""


def manifest(spark, sf):
    rows = assign_splits(views.recordings(spark, sf))
    return rows.withColumn("gait_system", F.col("speed")).withColumn(
        "frame_dir", F.concat(F.lit("raw/"), F.col("recording_id"))
    )


@query("manifest_roundtrip", MANIFEST_SQL)
def _(spark, sf):
    path = scratch_path(spark, "manifest")
    tables.write_manifest(manifest(spark, sf), path)
    return tables.read_manifest(spark, path, root="data")


@query("manifest_partitions", f"SELECT split, count(*) AS recordings FROM ({MANIFEST_SQL}) WHERE split <> 'train' GROUP BY split")
def _(spark, sf):
    path = scratch_path(spark, "manifest")
    tables.write_manifest(manifest(spark, sf), path, form="parquet")
    rows = spark.read.parquet(path).filter("split <> 'train'")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("recordings"))


@query(
    "features_roundtrip",
    f"""WITH {FEATURES_SQL}, {splits_sql('features', 0.4)}
    SELECT recording_id, window_start, split, CAST(u.i - 1 AS BIGINT) AS dim, round(CAST(features[u.i] AS DOUBLE), 9) AS x
    FROM features JOIN slots USING (subject_id), (SELECT unnest(range(1, 65)) AS i) u""",
)
def _(spark, sf):
    path = scratch_path(spark, "features")
    tables.write_features(assign_splits(views.features(spark, sf), heldout=0.4), path)
    rows = tables.read_features(spark, path)
    doubles = rows.withColumn("features", F.col("features").cast("array<double>"))
    return long_form(doubles, ["recording_id", "window_start", "split"])


HISTORY_ROWS = """SELECT event_type AS run_id, CAST(day(ts) AS BIGINT) AS epoch, max(event_id) AS step,
    round(avg(value), 9) AS train_loss, CASE WHEN day(ts) % 3 = 0 THEN round(max(value), 9) END AS tune_loss
  FROM events GROUP BY event_type, day(ts)"""


@query("history_roundtrip", HISTORY_ROWS)
def _(spark, sf):
    path = scratch_path(spark, "history")
    day = F.dayofmonth("ts").cast("bigint")
    rows = views.table(spark, sf, "events").groupBy(
        F.col("event_type").alias("run_id"), day.alias("epoch")
    ).agg(
        F.max("event_id").alias("step"),
        F.round(F.avg("value"), 9).alias("train_loss"),
        F.lit(None).cast("double").alias("train_cosine"),
        F.lit(1.0).alias("epoch_seconds"),
        F.max("value").alias("_tune"),
    )
    tune = F.when(
        F.col("epoch") % 3 == 0, F.struct(F.round("_tune", 9).alias("loss"), F.lit(0.0).alias("cosine"))
    )
    tables.write_history(rows.withColumn("tune", tune), path)
    back = tables.read_history(spark, path, lines=True)
    return back.select("run_id", "epoch", "step", "train_loss", F.col("tune.loss").alias("tune_loss"))


@query(
    "probe_results_roundtrip",
    f"""WITH {GUESS_SQL}, pairs AS (SELECT lang AS truth, prediction AS guess FROM guesses), {SCORES_SQL}
    SELECT 'rule' AS model, 'lang' AS task, (SELECT count(*) FROM guesses) AS train_examples, * FROM scores""",
)
def _(spark, sf):
    path = scratch_path(spark, "probes")
    rows = guesses(spark, sf)
    tables.write_probe_results(probes.classification_metrics(rows, "lang", "lang", rows, "rule"), path)
    return rounded(tables.read_probe_results(spark, path), *SCORE_NAMES)


@query(
    "report_roundtrip",
    f"WITH {TRACES_SQL} SELECT clips, round(trace_total, 9) AS trace_total, round(trace_clip, 9) AS trace_clip FROM traces",
)
def _(spark, sf):
    path = scratch_path(spark, "report")
    tables.write_report(geo.position_share(views.tokens(spark, sf)), path)
    rows = spark.read.schema("clips bigint, trace_total double, trace_clip double").json(path)
    return rounded(rows, "trace_total", "trace_clip")


def fingerprint_sql(columns: list[str], source: str, group: str = "") -> str:
    """``table_fingerprint`` in SQL: rows and the sum of row words."""
    cells = " || '|' || ".join(f"'{c}=' || coalesce(md5(CAST({c} AS VARCHAR)), 'null')" for c in sorted(columns))
    keys = f"{group}, " if group else ""
    return f"""SELECT {keys}count(*) AS "rows", CAST(sum({word(f"md5({cells})")}) AS VARCHAR) AS fingerprint
      FROM {source}""" + (f" GROUP BY {group}" if group else "")


@query("table_fingerprint", fingerprint_sql(["conv_id", "turn", "role", "text"], "conversations"))
def _(spark, sf):
    return tables.table_fingerprint(views.table(spark, sf, "conversations").select("turn", "text", "role", "conv_id"))


CHANGES_SQL = f"""keyed AS (SELECT event_type AS task, CAST(day(ts) AS BIGINT) AS run_no, event_id, user_id, props,
    CAST(hour(ts) AS BIGINT) AS h FROM events),
  hours AS (SELECT DISTINCT task, run_no, h FROM keyed),
  model AS ({fingerprint_sql(["event_id", "user_id", "props"], "keyed", "task, run_no")}),
  evaluation AS ({fingerprint_sql(["h"], "hours", "task, run_no")}),
  h AS (SELECT task, run_no, m.fingerprint AS f, e.fingerprint AS e
    FROM model m JOIN evaluation e USING (task, run_no))"""


@query(
    "result_history",
    f"""WITH {CHANGES_SQL} SELECT task, run_no, f AS feature_fingerprint, CASE WHEN lag(f) OVER w IS NULL THEN 'first'
      WHEN lag(f) OVER w <> f AND lag(e) OVER w <> e THEN 'both' WHEN lag(f) OVER w <> f THEN 'model'
      WHEN lag(e) OVER w <> e THEN 'evaluation' ELSE 'none' END AS change FROM h WINDOW w AS (PARTITION BY task ORDER BY run_no)""",
)
def _(spark, sf):
    # A day of one event type is a run: its rows are what was modelled, its hours how.
    path = scratch_path(spark, "results")
    keyed = views.table(spark, sf, "events").select(
        F.col("event_type").alias("task"),
        F.dayofmonth("ts").cast("bigint").alias("run_no"),
        "event_id",
        "user_id",
        "props",
        F.hour("ts").cast("bigint").alias("h"),
    )
    keys = ["task", "run_no"]
    model = tables.table_fingerprint(keyed.drop("h"), keys).withColumnRenamed("fingerprint", "feature_fingerprint")
    hours = tables.table_fingerprint(keyed.select(*keys, "h").distinct(), keys)
    rows = model.drop("rows").join(hours.drop("rows").withColumnRenamed("fingerprint", "evaluation_fingerprint"), keys)
    tables.append_results(rows.filter("run_no <= 15"), path)
    tables.append_results(rows.filter("run_no > 15"), path)
    history = tables.classify_changes(spark.read.parquet(path))
    return history.select("task", "run_no", "feature_fingerprint", "change")


def turn_frames(spark, sf):
    """Conversation turns as frames: the whole text's bytes, sixteen to a row."""
    raw = F.encode(F.col("text"), "utf-8")
    height = F.greatest(F.lit(1), F.ceil(F.length(raw) / 16)).cast("int")
    padded = F.rpad(F.hex(raw), height * 32, F.lit("0"))
    return views.turns(spark, sf).select(
        "directory",
        F.concat(F.col("directory"), F.lit("/"), F.regexp_replace("name", r"\.[^.]*$", ""), F.lit(".png")).alias("path"),
        height.alias("height"),
        F.lit(16).alias("width"),
        F.unhex(padded).alias("pixels"),
    )


STEM = "regexp_replace(name, '\\.[^.]*$', '')"


@query(
    "scan_frames",
    f"""WITH {TURNS_SQL} SELECT directory, directory || '/' || {STEM} || '.png' AS path FROM turns""",
)
def _(spark, sf):
    root = scratch_path(spark, "frames")
    files.write_frame_files(turn_frames(spark, sf), root)
    return files.scan_frames(spark, root).select("directory", "path")


@query(
    "frame_pixels",
    f"""WITH {TURNS_SQL}, b AS (SELECT directory || '/' || {STEM} || '.png' AS path,
      greatest(1, ceil(octet_length(encode(text)) / 16.0)::BIGINT) AS height, hex(encode(text)) AS h FROM turns)
    SELECT path, height, 16 AS width, md5(rpad(h, (height * 32)::INTEGER, '0')) AS content FROM b""",
)
def _(spark, sf):
    root = scratch_path(spark, "frames")
    files.write_frame_files(turn_frames(spark, sf), root)
    rows = files.read_frame_pixels(spark, root)
    return rows.select("path", "height", "width", F.md5(F.hex("pixels")).alias("content"))


@query(
    "tar_listing",
    f"""WITH {TURNS_SQL} SELECT directory || '/' || {STEM} || '.png' AS member, length(hex(encode(text))) // 2 AS size FROM turns""",
)
def _(spark, sf):
    root = scratch_path(spark, "listed")
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    rows = views.turns(spark, sf).select(
        F.concat(F.col("directory"), F.lit("/"), stem, F.lit(".png")).alias("member"),
        F.encode(F.col("text"), "utf-8").alias("payload"),
    )
    files.write_tar_shards(rows, root, shards=3, segment_bytes=4096)
    return files.list_tar_members(spark, f"{root}/*.tar.gz").select("member", "size")


@query(
    "tar_shards",
    f"""WITH {TURNS_SQL} SELECT directory || '/' || {STEM} || '.png' AS member,
      length(hex(encode(text))) // 2 AS bytes, md5(hex(encode(text))) AS content FROM turns""",
)
def _(spark, sf):
    root = scratch_path(spark, "shards")
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    rows = views.turns(spark, sf).select(
        F.concat(F.col("directory"), F.lit("/"), stem, F.lit(".png")).alias("member"),
        F.encode(F.col("text"), "utf-8").alias("payload"),
    )
    notes = rows.withColumn("member", F.concat("member", F.lit(".txt")))
    files.write_tar_shards(rows.unionByName(notes), root, shards=5)
    members = files.scan_tar_shards(spark, f"{root}/*.tar.gz")
    return members.select(
        "member", F.length("payload").cast("bigint").alias("bytes"), F.md5(F.hex("payload")).alias("content")
    )


def npy_members(batches):
    """Frames as one-frame ``.npy`` archive members."""
    import io

    import numpy as np

    for batch in batches:
        payloads = []
        for height, width, pixels in zip(batch["height"], batch["width"], batch["pixels"]):
            buffer = io.BytesIO()
            np.save(buffer, np.frombuffer(pixels, np.uint8).reshape(1, height, width))
            payloads.append(buffer.getvalue())
        yield batch[["member"]].assign(payload=payloads)


@query(
    "silhouette_shards",
    f"""WITH {PIXELS_SQL} SELECT 'v' || vec_id || '.npy' AS member, 0 AS frame_no,
      count(*) FILTER (v >= 128) AS lit, count(*) AS pixels FROM pixels GROUP BY vec_id""",
)
def _(spark, sf):
    root = scratch_path(spark, "silhouettes")
    named = views.pixel_frames(spark, sf).withColumn(
        "member", F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".npy"))
    )
    members = named.select("member", "height", "width", "pixels").mapInPandas(
        npy_members, "member string, payload binary"
    )
    files.write_tar_shards(members, root, shards=4)
    frames = files.decode_members(files.scan_tar_shards(spark, f"{root}/*.tar.gz"))
    text = F.hex("pixels")
    return frames.select(
        F.col("recording_id").alias("member"),
        "frame_no",
        (F.length(F.regexp_replace(text, "00", "")) / 2).cast("bigint").alias("lit"),
        F.length("pixels").cast("bigint").alias("pixels"),
    )
