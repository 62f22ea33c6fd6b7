"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.session import stored


def _least(edges: DataFrame) -> DataFrame:
    """Least neighbour of each ``u``, itself included."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    ends = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return ends.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``node, label`` of every node of an edge; the label is the component's least node.

    Each round is two groupings with partial aggregation and two joins, written to the
    shared folder; the rounds grow with the logarithm of the longest chain. Null ends are
    ignored, repeated edges and loops are harmless, no edges give no rows.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null").distinct()
    now = stored(now, "edges")
    state = None
    for _ in range(rounds):
        now = stored(_small_star(_large_star(now).distinct()).filter("u <> v").distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    loops = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b))).filter("node is not null").distinct()
    return loops.join(now.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").select(
        "node", F.coalesce("label", "node").alias("label")
    )
