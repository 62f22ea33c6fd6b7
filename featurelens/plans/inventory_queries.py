"""Inventory, split and window queries over documents and conversations."""

from pyspark.sql import functions as F

from featurelens.functions import geometry as geo
from featurelens.functions.hashing import draw_uniform, seeded_key
from featurelens.functions.ranking import sorted_index
from featurelens.operators import inventory as inv
from featurelens.operators import windows as win
from featurelens.plans import views
from featurelens.plans.registry import query
from featurelens.plans.sqltext import splits_sql, uniform, word
from featurelens.plans.views import PATHS_SQL, RECORDINGS_SQL, TURNS_SQL

SUBJECT = "subject_id"
TRIAL = r"^(WoJ|WJ)_([12])(_|$)"

PARSED_SQL = f"""parts AS (
  SELECT *, string_split(path, '/') AS p FROM paths),
parsed AS (
  SELECT doc_id, n_chars, path, p[1] AS subject_id, p[2] AS speed, p[-1] AS trial,
    regexp_extract(p[-1], '{TRIAL}', 1) AS clothing,
    CASE regexp_extract(p[-1], '{TRIAL}', 2) WHEN '1' THEN 'R2L' ELSE 'L2R' END AS direction,
    array_to_string(p[1:len(p)-1], '/') || '/' || regexp_extract(p[-1], '{TRIAL}', 1)
      AS source_video_id
  FROM parts
  WHERE starts_with(path, 'PA') AND len(p) >= 3 AND p[2] IN ('UGS', 'FGS')
    AND regexp_matches(p[-1], '{TRIAL}'))"""


@query(
    "parse_trial_paths",
    f"""WITH {PATHS_SQL}, {PARSED_SQL}
    SELECT doc_id, subject_id, speed AS gait_system, speed, clothing, direction,
      path AS recording_id, source_video_id FROM parsed""",
)
def _(spark, sf):
    return inv.parse_trial_paths(views.paths(spark, sf)).drop("path", "n_chars")


@query(
    "minimum_length_filter",
    f"""WITH {PATHS_SQL}, {PARSED_SQL},
    dirs AS (SELECT path, sum(n_chars) AS num_frames FROM parsed GROUP BY path)
    SELECT path AS recording_id, num_frames::BIGINT AS num_frames FROM dirs WHERE num_frames >= 1000""",
)
def _(spark, sf):
    rows = inv.parse_trial_paths(views.paths(spark, sf))
    sized = rows.groupBy("recording_id").agg(F.sum("n_chars").alias("num_frames"))
    return sized.filter(F.col("num_frames") >= 1000)


@query(
    "build_manifest",
    f"""WITH {TURNS_SQL},
    dirs AS (SELECT directory, count(*) AS num_frames FROM turns GROUP BY directory
      HAVING count(*) >= 4),
    p AS (SELECT *, string_split(directory, '/') AS p FROM dirs)
    SELECT p[1] AS subject_id, '' AS split, 'raw/' || directory AS frame_dir, num_frames,
      p[2] AS gait_system, p[2] AS speed, regexp_extract(p[-1], '{TRIAL}', 1) AS clothing,
      CASE regexp_extract(p[-1], '{TRIAL}', 2) WHEN '1' THEN 'R2L' ELSE 'L2R' END AS direction,
      directory AS recording_id,
      p[1] || '/' || p[2] || '/' || regexp_extract(p[-1], '{TRIAL}', 1) AS source_video_id
    FROM p""",
)
def _(spark, sf):
    files = views.turns(spark, sf).select(
        "directory", F.concat_ws("/", "directory", "name").alias("path")
    )
    return inv.build_manifest(files, clip_length=4, frame_root="raw")


@query(
    "assign_splits",
    f"""WITH {RECORDINGS_SQL}, {splits_sql('recordings', 0.2, 7)}
    SELECT recording_id, r.subject_id, split FROM recordings r JOIN slots USING (subject_id)""",
)
def _(spark, sf):
    rows = inv.assign_splits(views.recordings(spark, sf), heldout=0.2, seed=7)
    return rows.select("recording_id", "subject_id", "split")


@query(
    "split_summary",
    f"""WITH {RECORDINGS_SQL}, {splits_sql('recordings', 0.3, 1, 0.1)}
    SELECT split, count(*) AS recordings, count(DISTINCT r.subject_id) AS subjects
    FROM recordings r JOIN slots USING (subject_id) GROUP BY split""",
)
def _(spark, sf):
    rows = inv.assign_splits(views.recordings(spark, sf), heldout=0.3, seed=1, tune=0.1)
    return inv.split_summary(rows)


@query(
    "split_filter",
    f"""WITH {RECORDINGS_SQL}, {splits_sql('recordings', 0.3, 1)}
    SELECT recording_id, subject_id FROM recordings JOIN slots USING (subject_id)
    WHERE split = 'test'""",
)
def _(spark, sf):
    rows = inv.assign_splits(views.recordings(spark, sf), heldout=0.3, seed=1)
    return inv.select_split(rows, "test").select("recording_id", "subject_id")


OVERLAP_SQL = """SELECT l.split AS left_split, r.split AS right_split,
      (SELECT count(*) FROM (SELECT subject_id FROM held h WHERE h.split = l.split
        INTERSECT SELECT subject_id FROM held h WHERE h.split = r.split)) AS shared_subjects
    FROM (VALUES ('train', 1), ('tune', 2), ('test', 3)) l(split, i)
    JOIN (VALUES ('train', 1), ('tune', 2), ('test', 3)) r(split, i) ON l.i < r.i"""


@query(
    "split_leak_audit",
    f"""WITH {RECORDINGS_SQL}, {splits_sql('recordings', 0.2)},
    held AS (SELECT DISTINCT subject_id, split FROM recordings JOIN slots USING (subject_id))
    {OVERLAP_SQL}""",
)
def _(spark, sf):
    return inv.split_overlaps(inv.assign_splits(views.recordings(spark, sf)))


@query(
    "split_leak_found",
    f"""WITH {RECORDINGS_SQL},
    held AS (SELECT DISTINCT subject_id, CASE WHEN doc_id % 97 = 0 THEN 'test'
      WHEN doc_id % 89 = 0 THEN 'tune' ELSE 'train' END AS split FROM recordings)
    {OVERLAP_SQL}""",
)
def _(spark, sf):
    i = F.col("doc_id")
    split = F.when(i % 97 == 0, "test").when(i % 89 == 0, "tune").otherwise("train")
    return inv.split_overlaps(views.recordings(spark, sf).withColumn("split", split))


@query(
    "missing_cells",
    f"""WITH {RECORDINGS_SQL}, roster AS (SELECT subject_id FROM recordings
      UNION SELECT 'PA' || CAST(s_suppkey AS VARCHAR) FROM supplier),
    declared AS (SELECT s || '/' || c AS cell FROM (VALUES ('UGS'), ('FGS')) a(s),
      (VALUES ('WoJ'), ('WJ')) b(c))
    SELECT subject_id, cell FROM roster, declared
    EXCEPT SELECT subject_id, speed || '/' || clothing FROM recordings""",
)
def _(spark, sf):
    recordings = views.recordings(spark, sf)
    suppliers = views.table(spark, sf, "supplier")
    enrolled = suppliers.select(F.concat(F.lit("PA"), F.col("s_suppkey").cast("string")).alias("subject_id"))
    return inv.missing_cells(recordings, recordings.select("subject_id").unionByName(enrolled))


@query(
    "condition_cube",
    f"""WITH {RECORDINGS_SQL}
    SELECT speed, clothing, count(*) AS recordings, count(DISTINCT subject_id) AS subjects
    FROM recordings GROUP BY CUBE (speed, clothing)""",
)
def _(spark, sf):
    return inv.cell_cube(views.recordings(spark, sf))


@query(
    "manifest_summary",
    f"""WITH {RECORDINGS_SQL}
    SELECT count(*) AS recordings, count(DISTINCT source_video_id) AS source_videos,
      count(DISTINCT subject_id) AS subjects, min(num_frames) AS min_frames,
      round(avg(num_frames), 9) AS mean_frames, max(num_frames) AS max_frames
    FROM recordings""",
)
def _(spark, sf):
    summary = inv.manifest_summary(views.recordings(spark, sf))
    return summary.withColumn("mean_frames", F.round("mean_frames", 9))


@query(
    "frame_counts",
    f"""WITH {TURNS_SQL} SELECT directory, count(*) AS num_frames FROM turns GROUP BY directory""",
)
def _(spark, sf):
    files = views.turns(spark, sf).withColumn("path", F.concat_ws("/", "directory", "name"))
    return inv.count_frames(inv.image_files(files))


@query(
    "order_frames",
    f"""WITH {TURNS_SQL}, s AS (
      SELECT directory, directory || '/' || name AS path,
        regexp_replace(name, '\\.[^.]*$', '') AS stem FROM turns),
    n AS (SELECT *, bool_and(regexp_full_match(stem, '[0-9]+')) OVER (PARTITION BY directory) AS numeric
      FROM s)
    SELECT directory, path, row_number() OVER (PARTITION BY directory ORDER BY
      CASE WHEN numeric THEN CAST(stem AS BIGINT) END, path) - 1 AS frame_no FROM n""",
)
def _(spark, sf):
    files = views.turns(spark, sf).select(
        "directory", F.concat_ws("/", "directory", "name").alias("path")
    )
    return inv.order_frames(files)


@query(
    "recording_order",
    f"""WITH {RECORDINGS_SQL} SELECT recording_id, row_number() OVER (ORDER BY subject_id, recording_id) - 1 AS position
    FROM recordings""",
)
def _(spark, sf):
    rows = views.recordings(spark, sf).select("subject_id", "recording_id")
    ordered = sorted_index(rows, [], [F.col("subject_id"), F.col("recording_id")], out="position")
    return ordered.select("recording_id", "position")


@query(
    "concat_exports",
    f"""WITH {RECORDINGS_SQL}, {splits_sql('recordings', 0.3, 1)}
    SELECT recording_id, split FROM recordings JOIN slots USING (subject_id) WHERE split IN ('train', 'test')""",
)
def _(spark, sf):
    rows = inv.assign_splits(views.recordings(spark, sf), heldout=0.3, seed=1)
    parts = [inv.select_split(rows, split) for split in ("train", "test")]
    return parts[0].unionByName(parts[1]).select("recording_id", "split")


@query(
    "recording_durations",
    f"""WITH {RECORDINGS_SQL}
    SELECT recording_id, round(num_frames / 30.0::DOUBLE, 9) AS duration_seconds FROM recordings""",
)
def _(spark, sf):
    rows = inv.recording_durations(views.recordings(spark, sf), fps=30.0)
    return rows.select("recording_id", F.round("duration_seconds", 9).alias("duration_seconds"))


@query(
    "eval_windows",
    f"""WITH {RECORDINGS_SQL}
    SELECT recording_id, w AS window_index,
      round_even(w * (num_frames - 16) / 2.0::DOUBLE, 0)::BIGINT AS window_start
    FROM recordings, (SELECT unnest(range(3)) AS w) WHERE num_frames >= 16""",
)
def _(spark, sf):
    rows = win.eval_windows(views.recordings(spark, sf), clip_length=16, windows=3)
    return rows.select("recording_id", "window_index", "window_start")


@query(
    "centre_window",
    f"""WITH {RECORDINGS_SQL}
    SELECT recording_id, (num_frames - 16) // 2 AS window_start
    FROM recordings WHERE num_frames >= 16""",
)
def _(spark, sf):
    rows = win.eval_windows(views.recordings(spark, sf), clip_length=16)
    return rows.select("recording_id", "window_start")


@query(
    "train_windows",
    f"""WITH {RECORDINGS_SQL}
    SELECT recording_id, e AS epoch,
      {word("md5('3-' || e || '-' || recording_id)")} % (num_frames - 16 + 1) AS window_start
    FROM recordings, (SELECT unnest(range(2)) AS e) WHERE num_frames >= 16""",
)
def _(spark, sf):
    rows = views.recordings(spark, sf)
    first = win.train_windows(rows, 16, epoch=0, seed=3)
    second = win.train_windows(rows, 16, epoch=1, seed=3)
    both = first.unionByName(second)
    return both.select("recording_id", "epoch", "window_start")


BOXED_SQL = f"""boxed AS (
  SELECT recording_id, 64 + num_frames % 40 AS width, 48 + num_frames % 25 AS height,
    doc_id % 5 <> 0 AS has_box, 3 + doc_id % 9 AS l, 2 + doc_id % 7 AS t,
    30 + doc_id % 21 AS r, 25 + doc_id % 13 AS b,
    md5('5-2-' || recording_id) AS k, md5('5-2-' || recording_id || '-flip') AS kf
  FROM recordings),
drawn AS (SELECT *, 0.6::DOUBLE + {uniform('k', 1)} * (1.0 - 0.6)::DOUBLE AS s FROM boxed),
sized AS (SELECT *,
  CASE WHEN has_box THEN greatest(1, round_even((r - l) * s, 0)) ELSE round_even(width * s, 0) END::BIGINT AS cw,
  CASE WHEN has_box THEN greatest(1, round_even((b - t) * s, 0)) ELSE round_even(height * s, 0) END::BIGINT AS ch
  FROM drawn),
placed AS (SELECT *,
  CASE WHEN has_box THEN round_even((l + r) / 2.0::DOUBLE - cw / 2.0::DOUBLE, 0)::BIGINT
    ELSE {word('k', 2)} % (width - cw + 1) END AS cl,
  CASE WHEN has_box THEN round_even((t + b) / 2.0::DOUBLE - ch / 2.0::DOUBLE, 0)::BIGINT
    ELSE {word('k', 3)} % (height - ch + 1) END AS ct
  FROM sized)"""


@query(
    "augment_crops",
    f"""WITH {RECORDINGS_SQL}, {BOXED_SQL}
    SELECT recording_id, round(s, 9) AS scale, greatest(0, cl) AS crop_left,
      greatest(0, ct) AS crop_top, least(width, cl + cw) AS crop_right,
      least(height, ct + ch) AS crop_bottom, ({uniform('kf')} < 0.5)::INTEGER AS flip FROM placed""",
)
def _(spark, sf):
    i = F.col("doc_id")
    clips = views.recordings(spark, sf).select(
        "recording_id",
        (64 + F.col("num_frames") % 40).alias("width"),
        (48 + F.col("num_frames") % 25).alias("height"),
        F.when(i % 5 != 0, geo.box(3 + i % 9, 2 + i % 7, 30 + i % 21, 25 + i % 13)).alias("box"),
    )
    rows = win.augment_crops(clips, epoch=2, seed=5, scale_range=(0.6, 1.0), flip_probability=0.5)
    return rows.select(
        "recording_id",
        F.round("scale", 9).alias("scale"),
        *[F.col(f"crop.{s}").alias(f"crop_{s}") for s in ("left", "top", "right", "bottom")],
        F.col("flip").cast("int").alias("flip"),
    )


@query(
    "epoch_batches",
    f"""WITH {RECORDINGS_SQL}, r AS (
      SELECT recording_id, row_number() OVER (ORDER BY md5('0-4-' || recording_id), recording_id) - 1 AS o,
        count(*) OVER () AS n FROM recordings)
    SELECT recording_id, o // 64 AS batch, o % 64 AS slot FROM r WHERE o // 64 < n // 64""",
)
def _(spark, sf):
    rows = win.epoch_batches(views.recordings(spark, sf), batch_size=64, epoch=4)
    return rows.select("recording_id", "batch", "slot")


@query(
    "accumulation_sizes",
    f"""WITH {RECORDINGS_SQL}, b AS (
      SELECT DISTINCT (row_number() OVER (ORDER BY md5('0-0-' || recording_id), recording_id) - 1) // 48 AS batch
      FROM recordings)
    SELECT batch, least(4, (SELECT count(*) FROM b) - (batch // 4) * 4) AS accumulation_size FROM b""",
)
def _(spark, sf):
    rows = win.epoch_batches(views.recordings(spark, sf), 48, epoch=0, drop_last=False)
    batches = rows.select("batch").distinct()
    return win.accumulation_sizes(batches, batches.count(), steps=4)


@query(
    "window_frames",
    f"""WITH {TURNS_SQL}, f AS (
      SELECT directory AS recording_id, name, row_number() OVER (PARTITION BY directory ORDER BY turn) - 1 AS frame_no
      FROM turns),
    r AS (SELECT recording_id, count(*) AS n FROM f GROUP BY recording_id HAVING count(*) >= 3),
    w AS (SELECT recording_id, i AS window_index, round_even(i * (n - 3) / 2.0::DOUBLE, 0)::BIGINT AS window_start
      FROM r, (SELECT unnest(range(3)) AS i))
    SELECT w.recording_id, window_index, window_start, frame_no, name, frame_no - window_start AS clip_offset
    FROM w JOIN f ON f.recording_id = w.recording_id
      AND frame_no >= window_start AND frame_no < window_start + 3""",
)
def _(spark, sf):
    turns = views.turns(spark, sf).select(
        F.col("directory").alias("recording_id"), "name", "turn"
    )
    frames = turns.withColumnRenamed("turn", "frame_no")
    sizes = frames.groupBy("recording_id").agg(F.count(F.lit(1)).alias("num_frames"))
    windows = win.eval_windows(sizes, clip_length=3, windows=3).drop("num_frames")
    return win.window_frames(windows, frames, clip_length=3)


@query(
    "contact_sheet",
    f"""WITH {RECORDINGS_SQL}, m AS (SELECT recording_id, num_frames AS n, least(8, num_frames) AS m FROM recordings)
    SELECT recording_id, s AS slot, CASE WHEN s = m - 1 AND s > 0 THEN n - 1
      ELSE floor(s * ((n - 1)::DOUBLE / greatest(m - 1, 1)))::BIGINT END AS frame_no
    FROM m, (SELECT unnest(range(8)) AS s) WHERE s < m""",
)
def _(spark, sf):
    rows = win.contact_sheet(views.recordings(spark, sf))
    return rows.select("recording_id", "slot", "frame_no")


LETTER_SQL = """SELECT doc_id, out_w, out_h, (112 - out_w) // 2 AS off_x, (112 - out_h) // 2 AS off_y FROM (
    SELECT doc_id,
      CASE WHEN w >= h THEN 112 ELSE greatest(1, round_even(w / h::DOUBLE * 112, 0)) END::BIGINT AS out_w,
      CASE WHEN h >= w THEN 112 ELSE greatest(1, round_even(h / w::DOUBLE * 112, 0)) END::BIGINT AS out_h
    FROM (SELECT doc_id, 1 + n_chars % 960 AS w, 1 + (n_chars * 7) % 540 AS h FROM documents))"""


@query("letterbox_geometry", LETTER_SQL)
def _(spark, sf):
    docs = views.table(spark, sf, "documents")
    width, height = 1 + F.col("n_chars") % 960, 1 + (F.col("n_chars") * 7) % 540
    return docs.select("doc_id", geo.letterbox(width, height, 112).alias("g")).select("doc_id", "g.*")


@query(
    "mask_block_sizes",
    f"""SELECT doc_id,
      least(14, greatest(1, round_even(sqrt(29 * a), 0)))::BIGINT AS small_height,
      least(14, greatest(1, round_even(sqrt(29 / a), 0)))::BIGINT AS small_width,
      least(14, greatest(1, round_even(sqrt(108 * a), 0)))::BIGINT AS large_height,
      least(14, greatest(1, round_even(sqrt(108 / a), 0)))::BIGINT AS large_width
    FROM (SELECT doc_id, 0.75::DOUBLE + 0.75::DOUBLE * {uniform("md5('0-' || doc_id)")} AS a FROM documents)""",
)
def _(spark, sf):
    docs = views.table(spark, sf, "documents")
    aspect = F.lit(0.75) + F.lit(0.75) * draw_uniform(seeded_key(0, "doc_id"))
    sized = docs.select(
        "doc_id",
        geo.block_size(14, 0.15, aspect).alias("s"),
        geo.block_size(14, 0.55, aspect).alias("l"),
    )
    return sized.select(
        "doc_id",
        F.col("s.height").alias("small_height"),
        F.col("s.width").alias("small_width"),
        F.col("l.height").alias("large_height"),
        F.col("l.width").alias("large_width"),
    )
