"""Views that give the driver tables the roles of recordings, features, tokens and losses.

Each view comes twice: as a DataFrame and as a SQL common table expression, so a query
and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(test, yes: str, no: str):
    return F.when(test, yes).otherwise(no)


# Directories in the corpus grammar, with some that must be rejected.
PATHS_SQL = """paths AS (
  SELECT doc_id, n_chars,
    (CASE WHEN lang = 'es' THEN 'XX' ELSE 'PA' END) || substr(source, 4)
    || '/' || (CASE WHEN doc_id % 11 = 0 THEN 'SLOW' WHEN doc_id % 2 = 0 THEN 'UGS' ELSE 'FGS' END)
    || (CASE WHEN lang = 'fr' THEN '/TVL1' ELSE '' END)
    || '/' || (CASE WHEN (doc_id // 2) % 2 = 0 THEN 'WoJ' ELSE 'WJ' END)
    || '_' || CAST((doc_id // 4) % 3 + 1 AS VARCHAR)
    || (CASE WHEN lang = 'de' THEN '' ELSE '_' || CAST(doc_id AS VARCHAR) END) AS path
  FROM documents)"""


def paths(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(
        "doc_id",
        "n_chars",
        F.concat(
            _pick(F.col("lang") == "es", "XX", "PA"),
            F.substring("source", 4, 100),
            F.lit("/"),
            F.when(i % 11 == 0, "SLOW").when(i % 2 == 0, "UGS").otherwise("FGS"),
            _pick(F.col("lang") == "fr", "/TVL1", ""),
            F.lit("/"),
            _pick(F.floor(i / 2) % 2 == 0, "WoJ", "WJ"),
            F.lit("_"),
            (F.floor(i / 4) % 3 + 1).cast("string"),
            F.when(F.col("lang") == "de", "").otherwise(F.concat(F.lit("_"), i.cast("string"))),
        ).alias("path"),
    )


# Documents as recordings of 20 subjects.
RECORDINGS_SQL = """recordings AS (
  SELECT 'PA' || substr(source, 4) AS subject_id,
    CASE WHEN doc_id % 2 = 0 THEN 'UGS' ELSE 'FGS' END AS speed,
    CASE WHEN (doc_id // 2) % 2 = 0 THEN 'WoJ' ELSE 'WJ' END AS clothing,
    CASE WHEN (doc_id // 4) % 2 = 0 THEN 'R2L' ELSE 'L2R' END AS direction,
    'PA' || substr(source, 4) || '/' || CAST(doc_id AS VARCHAR) AS recording_id,
    'PA' || substr(source, 4) || '/' || CAST(doc_id // 8 AS VARCHAR) AS source_video_id,
    n_chars AS num_frames, doc_id, lang
  FROM documents)"""


def recordings(spark, sf):
    i = F.col("doc_id")
    subject = F.concat(F.lit("PA"), F.substring("source", 4, 100))
    speed = _pick(i % 2 == 0, "UGS", "FGS")
    return table(spark, sf, "documents").select(
        subject.alias("subject_id"),
        speed.alias("speed"),
        _pick(F.floor(i / 2) % 2 == 0, "WoJ", "WJ").alias("clothing"),
        _pick(F.floor(i / 4) % 2 == 0, "R2L", "L2R").alias("direction"),
        F.concat_ws("/", subject, i.cast("string")).alias("recording_id"),
        F.concat_ws("/", subject, F.floor(i / 8).cast("string")).alias("source_video_id"),
        F.col("n_chars").alias("num_frames"),
        "doc_id",
        "lang",
    )


# Conversations as recordings whose turns are frames, out of file order on purpose.
TURNS_SQL = """turns AS (
  SELECT conv_id, turn, role, text,
    'PA' || CAST(conv_id % 7 AS VARCHAR)
    || '/' || (CASE WHEN conv_id % 2 = 0 THEN 'UGS' ELSE 'FGS' END)
    || '/' || (CASE WHEN (conv_id // 2) % 2 = 0 THEN 'WoJ' ELSE 'WJ' END)
    || '_' || CAST((conv_id // 4) % 2 + 1 AS VARCHAR) || '_' || CAST(conv_id AS VARCHAR) AS directory,
    (CASE WHEN conv_id % 3 = 0 THEN 'f' ELSE '' END) || CAST(turn * 3 AS VARCHAR)
    || (CASE WHEN role = 'user' THEN '.png' WHEN role = 'system' THEN '.JPG' ELSE '.jpeg' END) AS name
  FROM conversations)"""


def turns(spark, sf):
    c = F.col("conv_id")
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat(
            F.lit("PA"),
            (c % 7).cast("string"),
            _pick(c % 2 == 0, "/UGS/", "/FGS/"),
            _pick(F.floor(c / 2) % 2 == 0, "WoJ_", "WJ_"),
            (F.floor(c / 4) % 2 + 1).cast("string"),
            F.lit("_"),
            c.cast("string"),
        ).alias("directory"),
        F.concat(
            _pick(c % 3 == 0, "f", ""),
            (F.col("turn") * 3).cast("string"),
            F.when(F.col("role") == "user", ".png")
            .when(F.col("role") == "system", ".JPG")
            .otherwise(".jpeg"),
        ).alias("name"),
    )


# Embeddings as pooled clip features of ten subjects.
FEATURES_SQL = """features AS (
  SELECT vec_id, 'S' || CAST(label AS VARCHAR) AS subject_id,
    CASE WHEN vec_id % 2 = 0 THEN 'UGS' ELSE 'FGS' END AS speed,
    CASE WHEN (vec_id // 2) % 2 = 0 THEN 'WoJ' ELSE 'WJ' END AS clothing,
    CASE WHEN (vec_id // 4) % 2 = 0 THEN 'R2L' ELSE 'L2R' END AS direction,
    'S' || CAST(label AS VARCHAR) || '/' || CAST(vec_id // 3 AS VARCHAR) AS recording_id,
    'S' || CAST(label AS VARCHAR) || '/' || CAST((vec_id // 2) % 4 AS VARCHAR) AS source_video_id,
    vec_id % 3 AS window_start, label, embedding AS features
  FROM embeddings)"""

# One row per feature element; dimensions are numbered from zero.
ELEMENTS_SQL = """elements AS (
  SELECT f.*, CAST(u.i - 1 AS BIGINT) AS dim, CAST(f.features[u.i] AS DOUBLE) AS x
  FROM features f, (SELECT unnest(range(1, 65)) AS i) u)"""


def features(spark, sf):
    i = F.col("vec_id")
    subject = F.concat(F.lit("S"), F.col("label").cast("string"))
    speed = _pick(i % 2 == 0, "UGS", "FGS")
    return table(spark, sf, "embeddings").select(
        "vec_id",
        subject.alias("subject_id"),
        speed.alias("gait_system"),
        speed.alias("speed"),
        _pick(F.floor(i / 2) % 2 == 0, "WoJ", "WJ").alias("clothing"),
        _pick(F.floor(i / 4) % 2 == 0, "R2L", "L2R").alias("direction"),
        F.concat_ws("/", subject, F.floor(i / 3).cast("string")).alias("recording_id"),
        F.concat_ws("/", subject, (F.floor(i / 2) % 4).cast("string")).alias("source_video_id"),
        (i % 3).alias("window_start"),
        "label",
        F.col("embedding").cast("array<double>").alias("features"),
    )


# Each embedding as a balanced grid of eight tokens with eight dimensions.
TOKENS_SQL = """tokens AS (
  SELECT e.vec_id AS clip_id, e.label, CAST(u.i // 8 AS BIGINT) AS pos,
    CAST(u.i % 8 AS BIGINT) AS dim, CAST(e.embedding[u.i + 1] AS DOUBLE) AS x
  FROM embeddings e, (SELECT unnest(range(0, 64)) AS i) u)"""


def tokens(spark, sf):
    wide = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("clip_id"),
        "label",
        F.col("embedding").cast("array<double>").alias("_v"),
        F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos"),
    )
    return wide.select(
        "clip_id",
        "label",
        F.col("pos").cast("bigint").alias("pos"),
        F.slice("_v", F.col("pos") * 8 + 1, 8).alias("features"),
    )


# Order lines as clips with unequal token counts and two feature dimensions.
RAGGED_SQL = """ragged AS (
  SELECT l_orderkey AS clip_id, CAST(l_linenumber AS BIGINT) AS pos,
    l_quantity AS x0, l_discount * 100 AS x1
  FROM lineitem)"""


def ragged(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("clip_id"),
        F.col("l_linenumber").cast("bigint").alias("pos"),
        F.array("l_quantity", F.col("l_discount") * 100).alias("features"),
    )


# Events as per-example losses under context conditions; 'view' is the true context.
LOSSES_SQL = """losses AS (
  SELECT CAST(user_id AS VARCHAR) AS subject_id, user_id, event_type AS condition, value AS loss,
    event_id, event_id // 10 AS sample_id, event_id % 2 AS mask_group, ts
  FROM events)"""


def losses(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("subject_id"),
        "user_id",
        F.col("event_type").alias("condition"),
        F.col("value").alias("loss"),
        "event_id",
        F.floor(F.col("event_id") / 10).alias("sample_id"),
        (F.col("event_id") % 2).alias("mask_group"),
        "ts",
    )


# Embeddings as 8 x 8 gray frames, ten to a recording; about a seventh of them blank.
PIXELS_SQL = """pixels AS (
  SELECT e.vec_id, e.label, e.vec_id // 10 AS rec, CAST(e.vec_id % 10 AS BIGINT) AS frame_no,
    CAST(u.i // 8 AS BIGINT) AS y, CAST(u.i % 8 AS BIGINT) AS x,
    CASE WHEN e.vec_id % 7 = 3 THEN 0 ELSE
      least(255, greatest(0, round_even(CAST(e.embedding[u.i + 1] AS DOUBLE) * 400 + 60, 0))) END::BIGINT AS v
  FROM embeddings e, (SELECT unnest(range(0, 64)) AS i) u)"""


def pixel_frames(spark, sf):
    gray = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda x: F.when(F.col("vec_id") % 7 == 3, 0).otherwise(
            F.least(F.lit(255), F.greatest(F.lit(0), F.rint(x * 400 + 60)))
        ).cast("bigint"),
    )
    text = F.array_join(F.transform(gray, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.concat(F.lit("R"), F.floor(F.col("vec_id") / 10).cast("string")).alias("recording_id"),
        (F.col("vec_id") % 10).alias("frame_no"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.unhex(text).alias("pixels"),
    )
