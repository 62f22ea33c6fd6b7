"""Hard negatives of anchor embeddings by Fagin's threshold algorithm.

Components become integers ``floor(scale * x)``; a score is the inner product of two such
vectors. Rows are packed into blocks where they are read, anchors into waves of bounded
size, and every wave meets every block once. In a meeting each dimension of the block is a
list sorted by its component; an anchor walks all lists at once, from the top where its own
component is positive and from the bottom where it is negative, scores each new row by
random access, and stops once the threshold (the score that the components at the present
depth would give, which no row not yet seen exceeds) falls strictly below the k-th score of
every window it has to fill, or below a window's lower end. The first search has one window
per anchor, all rows of its label, and gives the positives; their scores make the windows of
the second, over rows of other labels. Blocks give their k best each, and Spark keeps the k
best of all. No row is skipped: what the threshold leaves out cannot be among the results.

Scores are exact: whole numbers in doubles below 2**53, in longs above. Scaled components
beyond ``LIMIT`` count as that. Rows without label, with a null or empty vector, with null
or non-finite entries, or of another length than most vectors (the longest of equals) take
no part. A null id is no anchor and comes before all ids. Each row with an anchor's id is an
anchor of its own, and equal rows are results of their own. Windows of negative positive
scores are empty. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurelens.llm import dense
from featurelens.session import adapt, stored

SCALE = 256.0
POSITIVES = 5
NEGATIVES = 10
#: Window of a positive of score p: LOW * p <= 100 * score <= HIGH * p.
LOW, HIGH = 30, 90
LIMIT = 1 << 27
#: Rows of a block and anchors of a wave.
BLOCK = 4096
WAVE = 4096
#: Depth of the first step into the lists; each further step doubles it.
STEP = 16
NULL_ID = np.iinfo(np.int64).min

_BLOCKS = "block long, ids binary, labels binary, vectors binary"
_WAVES = "wave long, uids binary, anchors binary, anchor_labels binary, queries binary, windows binary"
_FOUND = "uid long, anchor_id long, slot int, score long, other long, other_id long"

SQL = """
WITH usable AS (
  SELECT vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         list_inner_product(a.q, b.q)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.other AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other))::INTEGER AS rank,
       s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
WHERE 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(scale * values), -LIMIT, LIMIT).astype(np.int32)


def _pack(width: int, scale: float):
    """Rows ``id, label, vector`` to blocks, numbered by task and place in it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block(size: int) -> pa.RecordBatch:
            nonlocal held, made
            ids, labels, vectors = (np.concatenate(part) for part in zip(*held, strict=True))
            held = [(ids[size:], labels[size:], vectors[size:])] if len(ids) > size else []
            number = [(task << 31) + made]
            made += 1
            columns = [pa.array(number, pa.int64()), *(pa.array([a[:size].tobytes()]) for a in (ids, labels, vectors))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "labels", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).fill_null(NULL_ID).to_numpy()
            vectors = quantised(dense.matrix(batch.column(2), width), scale)
            held.append((ids, batch.column(1).to_numpy(), vectors))
            while sum(len(h[0]) for h in held) >= BLOCK:
                yield block(BLOCK)
        if held:
            yield block(BLOCK)

    return pack


def unpacked(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    return ids, labels, np.frombuffer(row["vectors"], np.int32).reshape(-1, width)


#: A row's number is its block's, times BLOCK, plus its place in the block.
def _uids(block: int, count: int) -> np.ndarray:
    return np.int64(block) * BLOCK + np.arange(count, dtype=np.int64)


def _anchors(width: int, every: int):
    """Anchors of the blocks as rows ``uid, anchor_id, label, query``."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, vectors = unpacked(row, width)
                mine = np.flatnonzero((ids % every == 0) & (ids != NULL_ID))
                queries = pa.array([vectors[i].tobytes() for i in mine], pa.binary())
                columns = [pa.array(_uids(row["block"], len(ids))[mine]), pa.array(ids[mine]), pa.array(labels[mine]), queries]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "anchor_id", "label", "query"])

    return take


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with their windows (pairs of longs) to waves."""
    task, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        for first in range(0, batch.num_rows, WAVE):
            part = batch.slice(first, WAVE)
            windows = part.column(4).to_pylist()
            counts = np.array([len(w) for w in windows], np.int64)
            flat = np.array([[w["low"], w["high"]] for ws in windows for w in ws], np.int64)
            packed = [
                *(part.column(i).to_numpy().tobytes() for i in range(3)),
                b"".join(part.column(3).to_pylist()),
                counts.tobytes() + flat.tobytes(),
            ]
            columns = [pa.array([(task << 31) + made], pa.int64()), *(pa.array([b]) for b in packed)]
            made += 1
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _WAVES.split(", ")])


class Lists:
    """A block with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.size = ids, labels, len(ids)
        self.vectors = vectors.astype(np.float64)
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.most = float(np.abs(self.vectors).max(initial=0))
        self.seen_rows = 0

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products of some rows with the anchor."""
        if self.most * np.abs(query.astype(np.float64)).sum() < 2.0**53:
            return (self.vectors[rows] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[rows].astype(np.int64) @ query.astype(np.int64)

    def threshold(self, query: np.ndarray, up: np.ndarray, down: np.ndarray, depth: int) -> int:
        """No row outside the first ``depth`` places of every list has a greater score."""
        top = self.sorted[up, self.size - depth].astype(np.int64) @ query[up].astype(np.int64)
        return int(top + self.sorted[down, depth - 1].astype(np.int64) @ query[down].astype(np.int64))

    def search(self, query: np.ndarray, allowed: np.ndarray, windows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window, rows and scores of its ``k`` first allowed rows by score and id."""
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        score = np.zeros(self.size, np.int64)
        seen = np.zeros(self.size, bool)
        depth, step = 0, STEP
        while depth < self.size:
            last = min(depth + step, self.size)
            new = np.zeros(self.size, bool)
            new[self.order[up, self.size - last : self.size - depth]] = True
            new[self.order[down, depth:last]] = True
            if not len(up) and not len(down):
                new[:] = True  # every score is zero
            rows = np.flatnonzero(new & ~seen)
            score[rows] = self.scores(rows, query)
            seen[rows] = True
            depth, step = last, 2 * step
            bound = self.threshold(query, up, down, depth)
            have = score[seen & allowed]
            if all(bound < max(low, self._kth(have, low, high, k)) for low, high in windows.tolist()):
                break
            if depth < self.size and seen.all():
                break
        self.seen_rows += int(seen.sum())
        rows = np.flatnonzero(seen & allowed)
        out = []
        for low, high in windows.tolist():
            mine = rows[(score[rows] >= low) & (score[rows] <= high)]
            if len(mine) > k:
                mine = mine[score[mine] >= np.partition(score[mine], len(mine) - k)[len(mine) - k]]
            first = np.lexsort((mine, self.ids[mine], -score[mine]))[:k]
            out.append((mine[first], score[mine[first]]))
        return out

    @staticmethod
    def _kth(have: np.ndarray, low: int, high: int, k: int) -> int:
        inside = have[(have >= low) & (have <= high)]
        return int(np.partition(inside, len(inside) - k)[len(inside) - k]) if len(inside) >= k else low


def _meet(width: int, k: int, same: bool):
    """Each row holds a block and a wave; the ``k`` best of the block for every window."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, vectors = unpacked(row, width)
                lists, uids = Lists(ids, labels, vectors), _uids(row["block"], len(ids))
                anchors, ids_of, labels_of = (np.frombuffer(row[n], np.int64) for n in ("uids", "anchors", "anchor_labels"))
                queries = np.frombuffer(row["queries"], np.int32).reshape(-1, width)
                packed = np.frombuffer(row["windows"], np.int64)
                counts, flat = packed[: len(anchors)], packed[len(anchors) :].reshape(-1, 2)
                begins = np.cumsum(counts) - counts
                found: list[tuple[np.ndarray, ...]] = []
                for i in range(len(anchors)):
                    allowed = labels == labels_of[i] if same else labels != labels_of[i]
                    if same:
                        allowed &= uids != anchors[i]
                    windows = flat[begins[i] : begins[i] + counts[i]]
                    if not len(windows) or not allowed.any():
                        continue
                    for slot, (rows, scores) in enumerate(lists.search(queries[i], allowed, windows, k)):
                        if len(rows):
                            fixed = (np.full(len(rows), v) for v in (anchors[i], ids_of[i], slot))
                            found.append((*fixed, scores, uids[rows], ids[rows]))
                if found:
                    uid, anchor, slot, score, other, other_id = (np.concatenate(c) for c in zip(*found, strict=True))
                    columns = [pa.array(c) for c in (uid, anchor, slot.astype(np.int32), score, other)]
                    columns.append(pa.array(other_id, mask=other_id == NULL_ID))
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FOUND.split(", ")])

    return meet


def _best(blocks: DataFrame, waves: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """Every block meets every wave; the ``k`` best rows of each anchor and window, numbered from 1."""
    spark = blocks.sparkSession
    count = blocks.count()
    slots = max(1, min(count, 4 * spark.sparkContext.defaultParallelism))
    numbers = [r["wave"] for r in waves.select("wave").collect()]  # one for each WAVE anchors or task
    if not numbers:
        return spark.createDataFrame([], f"{_FOUND}, rank int")
    # Both sides are dealt by (wave, slot): a block is copied once for each wave, a wave for each slot.
    left = blocks.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots))).withColumn("wave", F.explode(F.lit(numbers).cast("array<bigint>")))
    right = waves.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))))
    parts = max(1, min(slots * len(numbers), 1 << 15))
    pairs = left.repartition(parts, "wave", "slot").join(right.repartition(parts, "wave", "slot"), ["wave", "slot"])
    found = pairs.drop("wave", "slot").mapInArrow(_meet(width, k, same), _FOUND)
    order = Window.partitionBy("uid", "slot").orderBy(F.desc("score"), F.asc_nulls_first("other_id"), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _waves(anchors: DataFrame) -> DataFrame:
    parts = max(1, -(-anchors.count() // WAVE))
    return stored(anchors.repartition(parts).mapInArrow(_gather, _WAVES), "negatives-waves")


def mine(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    every: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    scale: float = SCALE,
) -> DataFrame:
    """Negatives of each anchor (ids divisible by ``every``) and positive, best first."""
    spark = adapt(df.sparkSession)
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    rows = rows.filter(F.col("label").isNotNull() & dense.finite("vector"))
    width = dense.usual_width(rows)
    usable = rows.filter(F.size("vector") == width)
    blocks = stored(usable.mapInArrow(_pack(width, scale), _BLOCKS), "negatives-blocks")
    anchors = stored(
        blocks.mapInArrow(_anchors(width, every), "uid long, anchor_id long, label long, query binary"), "negatives-anchors"
    )
    whole = F.array(F.struct(F.lit(-(1 << 63)).cast("long").alias("low"), F.lit((1 << 63) - 1).cast("long").alias("high")))
    near = _best(blocks, _waves(anchors.withColumn("windows", whole)), width, positives, True)
    near = stored(near, "negatives-positives")
    # LOW * p <= 100 * s <= HIGH * p for whole s: from the ceiling of one to the floor of the other.
    score = F.col("score").cast("decimal(38,0)")
    low = F.ceil(score * LOW / 100).cast("long").alias("low")
    high = F.floor(score * HIGH / 100).cast("long").alias("high")
    windows = near.groupBy("uid").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", low, high))), lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))
        ).alias("windows")
    )
    far = _best(blocks, _waves(anchors.join(windows, "uid")), width, negatives, False)
    chosen = near.select(
        F.col("uid"), (F.col("rank") - 1).alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return far.join(chosen, ["uid", "slot"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("other_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
