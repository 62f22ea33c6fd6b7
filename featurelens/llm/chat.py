"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered with that speaker as
``assistant``, every other speaker as a named ``user`` and system turns as ``system``; the
masks cover the text and end mark of the speaker's own turns, the only ones trained on.

Turns follow ``(turn, speaker, md5 of the text)``, nulls first. A dialogue is cut between
turns into parts of about ``part_bytes``, so a conversation of any length is many rows of
bounded size; ordinary conversations are one part. Defined cases: a null text is empty, a
null or empty speaker is an unnamed user who gets no perspective, nor does the system; a
null conversation id is a conversation of its own; repeated rows are repeated turns; an
empty table gives no rows; columns beside the four are not read. ``<|`` inside a text
becomes ``< |``, so texts cannot forge marks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelens.llm import ordered
from featurelens.session import adapt

PART_BYTES = 1 << 16
#: Bytes counted for the marks of a turn when dialogues are cut into parts.
TURN_BYTES = 32


def perspectives(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    system: str = "system",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``conversation, speaker, part, n_turns, own_turns, text, masks`` per perspective.

    ``masks`` are character spans (start, end) of the part's text.
    """
    adapt(turns.sparkSession)
    said = turns.select(
        F.col(conversation).alias("conversation"),
        F.col(turn).alias("turn"),
        F.nullif(F.col(speaker).cast("string"), F.lit("")).alias("speaker"),
        F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    ).withColumns({"digest": F.md5(F.col("text").cast("binary")), "size": (F.octet_length("text") + TURN_BYTES).cast("long")})
    layout = ["turn", "speaker", "digest"]
    laid = ordered.ranged(said, [F.col("conversation"), *(F.col(c) for c in layout)], "dialogue")

    starts = ordered.offsets(laid, {"bytes": "size"}, ["conversation"])
    inside = Window.partitionBy("conversation", ordered.PART).orderBy(*layout)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = laid.withColumns({"seen": F.sum("size").over(upto), "nth": F.row_number().over(inside)})
    s = starts.select(F.col("conversation").alias("c"), F.col(ordered.PART).alias("p"), "bytes_before")
    placed = seen.join(s, F.col("conversation").eqNullSafe(F.col("c")) & (F.col(ordered.PART) == F.col("p"))).withColumn(
        "part", F.expr(f"(bytes_before + seen - size) div {part_bytes}")
    )
    # A part holds fewer than part_bytes before its last turn, so the lists are bounded.
    parts = placed.groupBy("conversation", "part").agg(
        F.array_sort(F.collect_list(F.struct(ordered.PART, "nth", "speaker", "text"))).alias("turns")
    )
    people = (
        said.filter(F.col("speaker").isNotNull() & (F.col("speaker") != system))
        .select(F.col("conversation").alias("c"), F.col("speaker").alias("self"))
        .distinct()
    )
    seen_by = parts.join(people, F.col("conversation").eqNullSafe(F.col("c")))

    def head(t):
        who = (
            F.when(t["speaker"] == F.col("self"), "assistant")
            .when(t["speaker"] == system, "system")
            .when(t["speaker"].isNull(), "user")
            .otherwise(F.concat(F.lit("user name="), t["speaker"]))
        )
        return F.concat(F.lit("<|im_start|>"), who, F.lit("\n"))

    end = F.lit("<|im_end|>\n")
    rendered = F.transform(
        "turns",
        lambda t: F.struct(
            head(t).alias("head"), t["text"].alias("text"), F.coalesce(t["speaker"] == F.col("self"), F.lit(False)).alias("own")
        ),
    )
    # The end mark without its line break is trained on, so the model learns to stop.
    spans = F.aggregate(
        "shown",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["text"]) + F.length(end)).alias("at"),
            F.when(
                t["own"],
                F.array_append(
                    acc["spans"],
                    F.struct(
                        (acc["at"] + F.length(t["head"])).alias("start"),
                        (acc["at"] + F.length(t["head"]) + F.length(t["text"]) + F.length(end) - 1).alias("end"),
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return seen_by.withColumn("shown", rendered).select(
        "conversation",
        F.col("self").alias("speaker"),
        "part",
        F.size("shown").cast("long").alias("n_turns"),
        F.size(F.filter("shown", lambda t: t["own"])).cast("long").alias("own_turns"),
        F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["text"], end)), "").alias("text"),
        spans.alias("masks"),
    )


#: The same perspectives over ``conversations`` in DuckDB; masks as ``start-end`` lists.
SQL = f"""
WITH said AS (
  SELECT conv_id, turn, nullif(role, '') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
sized AS (
  SELECT *, row_number() OVER w AS n,
    sum(strlen(text) + {TURN_BYTES}) OVER w - strlen(text) - {TURN_BYTES} AS before
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker NULLS FIRST, md5(text)
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
people AS (
  SELECT DISTINCT conv_id AS c, speaker AS self FROM said WHERE speaker IS NOT NULL AND speaker <> 'system'),
seen AS (
  SELECT s.conv_id, self, before // {PART_BYTES} AS part, n, text, coalesce(speaker = self, false) AS own,
    '<|im_start|>' || (CASE WHEN speaker = self THEN 'assistant' WHEN speaker = 'system' THEN 'system'
      WHEN speaker IS NULL THEN 'user' ELSE 'user name=' || speaker END) || chr(10) AS head
  FROM sized s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.c),
spans AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS shown,
    coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, self, part ORDER BY n
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS first
  FROM seen)
SELECT conv_id, self AS speaker, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
  count(*) FILTER (own) AS own_turns, string_agg(shown, '' ORDER BY n) AS text,
  coalesce(string_agg(CAST(first AS BIGINT) || '-' || CAST(first + length(text) + 10 AS BIGINT), ',' ORDER BY n)
    FILTER (own), '') AS masks
FROM spans GROUP BY conv_id, self, part
"""
