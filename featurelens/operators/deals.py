"""Token sums per clip after tokens were dealt to other clips, for the permutation null.

A deal is narrow: per (clip, position) the numbers of the clips that receive the token, one
per replicate. Vectors meet their deal once and are cut into pieces of ``dims`` elements;
a task folds the pieces of a block of positions into (replicate, clip) sums. What is
shuffled after that is sums per block, however many positions a block holds and however
often they were dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.functions import vectors as vec
from featurelens.functions.hashing import seeded_key
from featurelens.functions.ranking import seeded_index, sorted_index
from featurelens.session import materialise

#: Sums that a task holds; pieces of vectors, then ranges of replicates, get narrower to fit.
FOLD_BYTES = 64 * 1024 * 1024

_SUMS = "replicate int, clip int, piece int, tokens long, total array<double>"


def deals(tokens: DataFrame, replicates: int, seed: int) -> tuple[DataFrame, int]:
    """``clip_id, pos, targets`` with one clip number per replicate, and how many clips there are.

    The k-th clip of a position, by name, gives its token to the clip that is k-th in an
    order drawn for that replicate and position.
    """
    places = materialise(tokens.select("clip_id", "pos"))
    distinct = materialise(places.select("clip_id").distinct())
    count = distinct.count()
    clips = sorted_index(distinct, [], ["clip_id"], out="_clip", bound=count)
    numbered = places.join(clips, "clip_id")
    named = sorted_index(numbered, ["pos"], ["_clip"], out="_k", bound=count)
    copies = numbered.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    key = seeded_key(seed, "replicate", "pos", "clip_id")
    drawn = seeded_index(copies, ["replicate", "pos"], key, ["clip_id"], out="_k", bound=count)
    order = F.array_sort(F.collect_list(F.struct("replicate", F.col("_clip").cast("int").alias("clip"))))
    targets = drawn.groupBy("pos", "_k").agg(F.transform(order, lambda d: d["clip"]).alias("targets"))
    return named.join(targets, ["pos", "_k"]).select("clip_id", "pos", "targets"), count


def _runs(columns: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spans of rows that agree in all columns."""
    changed = np.zeros(len(columns[0]), bool)
    changed[0] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    begins = np.flatnonzero(changed)
    return list(zip(begins.tolist(), [*begins[1:].tolist(), len(changed)], strict=True))


def _rows(replicate: int, clips: np.ndarray, piece: int, tokens: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    n = len(clips)
    offsets = pa.array(np.arange(0, total.size + 1, total.shape[1], dtype=np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, replicate, np.int32)),
            pa.array(clips.astype(np.int32)),
            pa.array(np.full(n, piece, np.int32)),
            pa.array(tokens if piece == 0 else np.zeros(n, np.int64)),
            pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(total).ravel())),
        ],
        names=["replicate", "clip", "piece", "tokens", "total"],
    )


def _fold(clips: int, dims: int, span: int, dense: bool):
    """Rows sorted by (block, piece, part) to sums of each replicate and clip.

    ``span`` replicates belong to a part. Without ``dense`` (more clips than a task may
    hold sums for) the sums of each batch are passed on at once.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, sums = None, np.zeros(0), np.zeros(0)

        def emit() -> Iterator[pa.RecordBatch]:
            if held is None or not dense:
                return
            for r in range(len(tokens)):
                hit = np.flatnonzero(tokens[r])
                for first in range(0, len(hit), 10_000):
                    some = hit[first : first + 10_000]
                    yield _rows(held[2] * span + r, some, held[1], tokens[r, some], sums[r, some])

        for batch in batches:
            if not batch.num_rows:
                continue
            groups = [batch.column(i).to_numpy() for i in range(3)]
            for first, last in _runs(groups):
                group = tuple(int(g[first]) for g in groups)
                part = batch.slice(first, last - first)
                targets = part.column(3).flatten().to_numpy().reshape(part.num_rows, -1)
                values = vec.matrix(part, column="values", width=dims)
                if group != held:
                    yield from emit()
                    held = group
                    size = clips if dense else 0
                    tokens = np.zeros((targets.shape[1], size), np.int64)
                    sums = np.zeros((targets.shape[1], size, dims))
                for r in range(targets.shape[1]):
                    order = np.argsort(targets[:, r], kind="stable")
                    hit, begins, count = np.unique(targets[order, r], return_index=True, return_counts=True)
                    total = np.add.reduceat(values[order], begins, axis=0)
                    if dense:
                        tokens[r, hit] += count
                        sums[r, hit] += total
                    else:
                        yield _rows(group[2] * span + r, hit, group[1], count, total)
        yield from emit()

    return fold


def dealt_sums(
    tokens: DataFrame, dealt: DataFrame, clips: int, replicates: int, width: int, blocks: int | None = None
) -> DataFrame:
    """Partial sums ``replicate, clip, piece, tokens, total`` of each block of positions.

    A clip's tokens of a block stand in the rows of piece 0. At most ``blocks`` x
    replicates x clips x pieces rows come out.
    """
    blocks = blocks or int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = 8 * max(clips, 1)
    dims = max(1, min(width, FOLD_BYTES // (cell * replicates)))
    span = min(replicates, max(1, FOLD_BYTES // (2 * cell)))
    pieces, parts = -(-width // dims), -(-replicates // span)
    padded = F.concat(vec.as_doubles(vec.whole("features", width)), F.array_repeat(F.lit(0.0), pieces * dims - width))
    grid = (
        tokens.join(dealt, ["clip_id", "pos"])
        .select(F.pmod(F.xxhash64("pos"), F.lit(blocks)).cast("int").alias("block"), "targets", padded.alias("_all"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        .select(
            "block",
            "piece",
            "part",
            F.slice("targets", F.col("part") * span + 1, F.lit(span)).alias("targets"),
            F.slice("_all", F.col("piece") * dims + 1, F.lit(dims)).alias("values"),
        )
    )
    sorted_cells = grid.repartition("block", "piece", "part").sortWithinPartitions("block", "piece", "part")
    return sorted_cells.mapInArrow(_fold(clips, dims, span, 2 * cell <= FOLD_BYTES), _SUMS)


def merged(sums: DataFrame) -> DataFrame:
    """Per replicate: tokens, and the sum over clips of squared token sum over token count."""
    whole = sums.groupBy("replicate", "clip", "piece").agg(F.sum("tokens").alias("tokens"), vec.sums("total").alias("total"))
    clips = whole.groupBy("replicate", "clip").agg(
        F.sum("tokens").alias("tokens"), F.sum(vec.squared_norm("total")).alias("norm")
    )
    return clips.groupBy("replicate").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.col("norm") / F.col("tokens")).alias("by_clip")
    )
