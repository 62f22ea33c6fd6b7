"""Boxes, clips, patch tokens, encoders and masks over derived pixel frames."""

from pyspark.sql import functions as F

from featurelens.config import ClipConfig
from featurelens.functions import geometry as geo
from featurelens.functions.hashing import draw_below, seeded_key
from featurelens.operators import clips, masks, probes
from featurelens.operators.export import export_clips, export_features
from featurelens.operators.windows import epoch_batches, eval_windows, window_frames
from featurelens.plans import views
from featurelens.plans.feature_queries import long_form, rounded
from featurelens.plans.probe_queries import split_features
from featurelens.plans.registry import query
from featurelens.plans.sqltext import uniform, word
from featurelens.plans.views import PIXELS_SQL
from featurelens.session import materialise

LENGTH, WINDOWS, KEYS = 4, 2, ["recording_id", "window_index"]

BOX_SQL = f"""{PIXELS_SQL}, boxes AS (SELECT vec_id, rec, frame_no, min(x) FILTER (v > 110) AS l, min(y) FILTER (v > 110) AS t,
    max(x) FILTER (v > 110) + 1 AS r, max(y) FILTER (v > 110) + 1 AS b FROM pixels GROUP BY ALL),
  sizes AS (SELECT rec, count(*) AS n FROM boxes GROUP BY rec HAVING count(*) >= 4),
  win AS (SELECT rec, w AS window_index, round_even(w * (n - 4) / 1.0::DOUBLE, 0)::BIGINT AS window_start
    FROM sizes, (SELECT unnest(range(2)) AS w)),
  covered AS (SELECT win.rec, window_index, window_start, vec_id, frame_no - window_start AS o
    FROM win JOIN boxes USING (rec) WHERE frame_no BETWEEN window_start AND window_start + 3)"""


def windowed(spark, sf):
    frames = views.pixel_frames(spark, sf)
    sizes = frames.groupBy("recording_id").agg(F.count(F.lit(1)).alias("num_frames"))
    windows = eval_windows(sizes, LENGTH, WINDOWS).drop("num_frames")
    return frames, windows


@query(
    "frame_boxes",
    f"""WITH {BOX_SQL} SELECT vec_id, l AS box_left, t AS box_top, r AS box_right, b AS box_bottom FROM boxes""",
)
def _(spark, sf):
    boxes = clips.frame_boxes(views.pixel_frames(spark, sf), threshold=110)
    return boxes.select("vec_id", *[F.col(f"box.{s}").alias(f"box_{s}") for s in ("left", "top", "right", "bottom")])


WINDOW_BOX_SQL = f"""{BOX_SQL}, u AS (SELECT c.rec, window_index, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b
    FROM covered c JOIN boxes USING (vec_id) GROUP BY ALL),
  crops AS (SELECT rec, window_index, greatest(0, l - round_even((r - l) * 0.15::DOUBLE, 0))::BIGINT AS cl,
    greatest(0, t - round_even((b - t) * 0.15::DOUBLE, 0))::BIGINT AS ct,
    least(8, r + round_even((r - l) * 0.15::DOUBLE, 0))::BIGINT AS cr,
    least(8, b + round_even((b - t) * 0.15::DOUBLE, 0))::BIGINT AS cb FROM u)"""


@query(
    "window_boxes",
    f"""WITH {WINDOW_BOX_SQL} SELECT 'R' || rec AS recording_id, window_index, cl AS crop_left, ct AS crop_top,
      cr AS crop_right, cb AS crop_bottom FROM crops""",
)
def _(spark, sf):
    frames, windows = windowed(spark, sf)
    boxes = clips.frame_boxes(frames, threshold=110)
    found = clips.window_boxes(window_frames(windows, boxes, LENGTH), KEYS)
    return found.select(*KEYS, *[F.col(f"crop.{s}").alias(f"crop_{s}") for s in ("left", "top", "right", "bottom")])


@query(
    "table_boxes",
    """WITH u AS (SELECT l_orderkey, min(l_quantity)::BIGINT AS l, min(l_linenumber) AS t, max(l_quantity)::BIGINT + 1 AS r,
      max(l_linenumber) + 1 AS b FROM lineitem WHERE l_discount > 0.05 GROUP BY 1)
    SELECT l_orderkey, greatest(0, l - round_even((r - l) * 0.15::DOUBLE, 0))::BIGINT AS crop_left,
      greatest(0, t - round_even((b - t) * 0.15::DOUBLE, 0))::BIGINT AS crop_top,
      least(51, r + round_even((r - l) * 0.15::DOUBLE, 0))::BIGINT AS crop_right,
      least(8, b + round_even((b - t) * 0.15::DOUBLE, 0))::BIGINT AS crop_bottom FROM u""",
)
def _(spark, sf):
    lit = views.table(spark, sf, "lineitem").filter("l_discount > 0.05")
    union = lit.groupBy("l_orderkey").agg(
        geo.box(F.min("l_quantity"), F.min("l_linenumber"), F.max("l_quantity") + 1, F.max("l_linenumber") + 1).alias("b")
    )
    crop = geo.add_margin(F.col("b"), 0.15, F.lit(51), F.lit(8))
    return union.select("l_orderkey", crop.alias("c")).select(
        "l_orderkey", *[F.col(f"c.{s}").alias(f"crop_{s}") for s in ("left", "top", "right", "bottom")]
    )


def plain_clips(spark, sf):
    """Windows at the frames' own size, without crop or flip."""
    frames, windows = windowed(spark, sf)
    covered = window_frames(windows, frames, LENGTH)
    return covered.withColumn("crop", F.lit(None).cast("struct<left:bigint,top:bigint,right:bigint,bottom:bigint>")).withColumn(
        "flip", F.lit(False)
    ).select(*KEYS, "clip_offset", "height", "width", "pixels", "crop", "flip")


def cropped_clips(spark, sf, size=12):
    """Windows cut to their foreground box, flipped by a seeded draw, resized."""
    frames, windows = windowed(spark, sf)
    covered = window_frames(windows, frames, LENGTH).drop("window_start", "frame_no", "vec_id")
    boxes = clips.window_boxes(
        clips.frame_boxes(covered, threshold=110), KEYS
    ).select(*KEYS, "crop")
    flip = draw_below(seeded_key(0, *KEYS), 2) == 0
    joined = covered.join(boxes, KEYS).withColumn("flip", flip)
    return clips.materialise_clips(
        joined.select(*KEYS, "clip_offset", "height", "width", "pixels", "crop", "flip"), size
    )


@query("materialise_clips")
def _(spark, sf):
    return cropped_clips(spark, sf).select(*KEYS, "clip_offset", F.hex("pixels").alias("pixels"))


@query(
    "patchify",
    f"""WITH {BOX_SQL} SELECT 'R' || c.rec AS recording_id, window_index, (o // 2) * 4 + (y // 4) * 2 + x // 4 AS pos,
      (o % 2) * 16 + (y % 4) * 4 + x % 4 AS dim, round(v / 255.0::DOUBLE, 9) AS x
    FROM covered c JOIN pixels p USING (vec_id)""",
)
def _(spark, sf):
    rendered = clips.materialise_clips(plain_clips(spark, sf), 8)
    return long_form(clips.patchify(rendered, KEYS, size=8, patch=4, tubelet=2), [*KEYS, "pos"])


@query(
    "foreground_share",
    f"""WITH {BOX_SQL}, t AS (SELECT c.rec, window_index, (o // 2) * 4 + (y // 4) * 2 + x // 4 AS pos,
      count(*) FILTER (v / 255.0::DOUBLE > 0.4) AS lit, count(*) AS n FROM covered c JOIN pixels p USING (vec_id) GROUP BY ALL)
    SELECT 'R' || rec AS recording_id, window_index, round(sum(lit) / sum(n), 9) AS pixel_share,
      round(avg((lit > 0)::INTEGER), 9) AS patch_share FROM t GROUP BY rec, window_index""",
)
def _(spark, sf):
    rendered = clips.materialise_clips(plain_clips(spark, sf), 8)
    tokens = clips.patchify(rendered, KEYS, size=8, patch=4, tubelet=2)
    return rounded(clips.foreground_share(tokens, KEYS, level=0.4), "pixel_share", "patch_share")


def level_encoder():
    """A frozen encoder for checks: one token per frame with its mean and peak gray level."""
    def encode(video):
        import numpy as np

        levels = np.rint((video * 0.5 + 0.5) * 255).reshape(*video.shape[:2], -1)
        return np.stack([levels.mean(axis=2), levels.max(axis=2)], axis=2)

    return encode


@query(
    "score_clips",
    f"""WITH {BOX_SQL}, m AS (SELECT c.rec, window_index, vec_id, avg(v) AS a, max(v) AS b
      FROM covered c JOIN pixels p USING (vec_id) GROUP BY ALL)
    SELECT 'R' || rec AS recording_id, window_index, round(avg(a), 9) AS mean_level, round(avg(b), 9) AS peak_level
    FROM m GROUP BY rec, window_index""",
)
def _(spark, sf):
    rendered = clips.materialise_clips(plain_clips(spark, sf), 8)
    scored = clips.score_clips(rendered, KEYS, 8, level_encoder, width=2)
    levels = [F.col("features")[i].cast("double").alias(n) for i, n in enumerate(("mean_level", "peak_level"))]
    return rounded(scored.select(*KEYS, *levels), "mean_level", "peak_level")


def recordings_of_frames(spark, sf):
    """Every recording of the pixel frames, all in one split."""
    frames = views.pixel_frames(spark, sf)
    return frames, frames.select("recording_id").distinct().withColumn("split", F.lit("test")).withColumn("num_frames", F.lit(0))


@query(
    "export_features",
    f"""WITH {BOX_SQL}, m AS (SELECT c.rec, window_index, vec_id, avg(v) AS a, max(v) AS b
      FROM covered c JOIN pixels p USING (vec_id) GROUP BY ALL)
    SELECT 'R' || rec AS recording_id, window_index, window_start, round(avg(a), 9) AS mean_level, round(avg(b), 9) AS peak_level
    FROM m JOIN win USING (rec, window_index) GROUP BY rec, window_index, window_start""",
)
def _(spark, sf):
    frames, manifest = recordings_of_frames(spark, sf)
    config = ClipConfig(num_frames=LENGTH, img_size=8, patch_size=4, windows=WINDOWS, foreground_crop=False)
    out = export_features(manifest, frames, config, level_encoder, width=2)
    levels = [F.col("features")[i].cast("double").alias(n) for i, n in enumerate(("mean_level", "peak_level"))]
    return rounded(out.select(*KEYS, "window_start", *levels), "mean_level", "peak_level")


@query(
    "train_clips",
    f"""WITH {PIXELS_SQL}, sizes AS (SELECT rec, 'R' || rec AS recording_id, count(DISTINCT vec_id) AS n FROM pixels GROUP BY rec
      HAVING count(DISTINCT vec_id) >= 4),
    drawn AS (SELECT *, {word("md5('3-2-' || recording_id)")} % (n - 3) AS s,
      {uniform("md5('3-2-' || recording_id || '-flip')")} < 0.5 AS flip FROM sizes)
    SELECT recording_id, frame_no - s AS clip_offset, string_agg(printf('%02X', v), '' ORDER BY y, CASE WHEN flip THEN 7 - x ELSE x END) AS pixels
    FROM pixels JOIN drawn USING (rec) WHERE frame_no BETWEEN s AND s + 3 GROUP BY ALL""",
)
def _(spark, sf):
    frames, manifest = recordings_of_frames(spark, sf)
    config = ClipConfig(num_frames=LENGTH, img_size=8, patch_size=4, foreground_crop=False, flip_probability=0.5, seed=3)
    _, rendered = export_clips(manifest, frames, config, epoch=2)
    return rendered.select("recording_id", F.col("clip_offset").cast("bigint").alias("clip_offset"), F.hex("pixels").alias("pixels"))


@query("random_control")
def _(spark, sf):
    encoder = clips.random_encoder(patch=4, tubelet=2, width=16)
    scored = clips.score_clips(cropped_clips(spark, sf), KEYS, 12, encoder, width=16)
    return scored.select(*KEYS, F.posexplode("features").alias("dim", "x"))


@query("run_probes")
def _(spark, sf):
    table = split_features(spark, sf)
    control = materialise(clips.project_features(table, 64, 64))
    return probes.run_probes({"trained": table, "random_init": control})


def small_masks(spark, sf):
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    samples = epoch_batches(docs, 16, epoch=0, id_column="sample_id", drop_last=False)
    return masks.sample_masks(samples, grid=4, steps=2, min_context_tokens=4)


# Mask sampling spelled out relationally; the first of 64 attempts that fits is used.
MASK_SQL = f"""smp AS (SELECT doc_id AS sample_id, (row_number() OVER (ORDER BY md5('0-0-' || doc_id), doc_id) - 1) // 16 AS batch FROM documents),
  grp AS (SELECT * FROM (VALUES (0, 'small_blocks', 8, 2.0::DOUBLE), (1, 'large_blocks', 2, 9.0::DOUBLE)) t(g, label, nb, area)),
  asp AS (SELECT batch, g, label, nb, area, 0.75::DOUBLE + 0.75::DOUBLE * {uniform("md5('0-' || g || '-' || batch)")} AS a
    FROM (SELECT DISTINCT batch FROM smp), grp),
  blk AS (SELECT *, least(4, greatest(1, round_even(sqrt(area * a), 0)))::BIGINT AS h, least(4, greatest(1, round_even(sqrt(area / a), 0)))::BIGINT AS w FROM asp),
  att AS (SELECT sample_id, batch, g, nb, h, w, unnest(range(64)) AS attempt FROM smp JOIN blk USING (batch)),
  pos AS (SELECT *, md5('0-' || g || '-' || sample_id || '-' || attempt || '-' || b) AS k FROM (SELECT *, unnest(range(nb)) AS b FROM att)),
  put AS (SELECT sample_id, batch, g, attempt, {word('k', 0)} % (4 - h + 1) AS t, {word('k', 1)} % (4 - w + 1) AS l, h, w FROM pos),
  cel AS (SELECT DISTINCT sample_id, batch, g, attempt, (t + i // w) * 4 + l + i % w AS cell FROM (SELECT *, unnest(range(h * w)) AS i FROM put)),
  ok AS (SELECT sample_id, g, min(attempt) AS attempt FROM (SELECT sample_id, g, attempt FROM cel GROUP BY ALL HAVING 16 - count(*) >= 2) GROUP BY ALL),
  tgt AS (SELECT sample_id, batch, g, cell FROM cel JOIN ok USING (sample_id, g, attempt)),
  ctx AS (SELECT s.sample_id, s.batch, grp.g, c.cell FROM smp s, grp, (SELECT unnest(range(16)) AS cell) c
    ANTI JOIN tgt ON tgt.sample_id = s.sample_id AND tgt.g = grp.g AND tgt.cell = c.cell),
  side AS (SELECT *, 'pred' AS role FROM tgt UNION ALL SELECT *, 'ctx' FROM ctx),
  keep AS (SELECT batch, g, role, min(n) AS keep FROM (SELECT sample_id, batch, g, role, count(*) AS n FROM side GROUP BY ALL) GROUP BY ALL),
  chosen AS (SELECT * FROM (SELECT side.*, keep, row_number() OVER (PARTITION BY sample_id, g, role
      ORDER BY md5('0-' || g || '-' || sample_id || '-' || role || '-' || cell), cell) AS rn FROM side JOIN keep USING (batch, g, role)) WHERE rn <= keep)"""


@query(
    "sample_masks",
    f"""WITH {MASK_SQL} SELECT sample_id, batch, g AS mask_group, label, role, t * 16 + cell AS cell
    FROM chosen JOIN grp USING (g), (SELECT unnest(range(2)) AS t)""",
)
def _(spark, sf):
    return masks.mask_cells(small_masks(spark, sf))


@query(
    "mask_audit",
    """SELECT g AS mask_group, label, count(*) AS samples, 0 AS overlapping_cells, 0 AS ragged_batches
    FROM documents, (VALUES (0, 'small_blocks'), (1, 'large_blocks')) t(g, label) GROUP BY ALL""",
)
def _(spark, sf):
    return masks.mask_audit(small_masks(spark, sf))


@query(
    "context_complement",
    f"""WITH {MASK_SQL} SELECT sample_id, g AS mask_group, cell FROM ctx""",
)
def _(spark, sf):
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    samples = epoch_batches(docs, 16, epoch=0, id_column="sample_id", drop_last=False).select("sample_id", "batch")
    cells = samples.select(
        "sample_id",
        F.explode(F.array(F.lit(0), F.lit(1))).alias("mask_group"),
    ).select("sample_id", "mask_group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))).alias("cell"))
    targets = masks.mask_targets(samples, grid=4, steps=2, min_context_tokens=4)
    return masks.context_complement(targets, cells)


@query(
    "mask_union",
    f"""WITH {MASK_SQL} SELECT sample_id, count(DISTINCT cell) AS cells FROM tgt GROUP BY sample_id""",
)
def _(spark, sf):
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    samples = epoch_batches(docs, 16, epoch=0, id_column="sample_id", drop_last=False).select("sample_id", "batch")
    targets = masks.mask_targets(samples, grid=4, steps=2, min_context_tokens=4)
    return targets.groupBy("sample_id").agg(F.countDistinct("cell").alias("cells"))


@query(
    "token_coordinates",
    """SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 1568) // 196 AS t, ((l_partkey % 1568) % 196) // 14 AS "row",
      (l_partkey % 1568) % 14 AS "column" FROM lineitem""",
)
def _(spark, sf):
    rows = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    at = geo.token_coordinates(F.col("l_partkey") % 1568, 14)
    return rows.withColumn("c", at).select("l_orderkey", "l_linenumber", "l_partkey", "c.*")
