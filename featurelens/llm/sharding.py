"""Contiguous shards of nearly equal bytes from global prefix sums.

Documents are laid out by ``(doc_id, crc32, size)`` in range partitions. Each partition's
byte total is one row; running totals over those rows give every partition its start, and
the prefix sum inside a partition completes the global position of each document. The line
of ``total`` bytes is cut at ``total * k / shards``; a document belongs to the shard that
holds its midpoint, so shards are contiguous and differ by at most one document's size.

Size is the UTF-8 bytes of the text (null: none) plus 1. Null ids come first; repeated rows
take neighbouring places, in either order alike; an empty table gives an empty result and
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelens.llm import ordered
from featurelens.session import adapt


def shards(docs: DataFrame, count: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; slots have no gaps."""
    if count < 1:
        raise ValueError("at least one shard is needed")
    adapt(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    layout = ["doc_id", "text_crc32", "size"]
    laid = ordered.ranged(narrow, [F.col(c) for c in layout], "shards").withColumn("one", F.lit(1).cast("long"))
    starts = ordered.offsets(laid, {"bytes": "size", "rows": "one"})
    inside = Window.partitionBy(ordered.PART).orderBy(*layout)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        laid.withColumn("seen", F.sum("size").over(upto))
        .withColumn("nth", F.row_number().over(inside))
        # One row per partition: as bounded as the partition count.
        .join(F.broadcast(starts), ordered.PART)
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("seen")) - F.col("size"))
        .withColumn(
            "shard",
            F.least(F.lit(count - 1), F.expr(f"int(div(cast(middle as decimal(38, 0)) * {count}, 2 * bytes_all))")),
        )
        .withColumn("place", F.col("rows_before") + F.col("nth") - 1)
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot")
    )
