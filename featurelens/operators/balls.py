"""Exact nearest centroids and ranks through balls around pivots.

Centroids belong to their nearest pivot and are cut, by distance to it, into rings of
bounded size. The triangle inequality bounds how close any centroid of a ring can be to a
query. A ring is visited only if it may hold the best match, or centroids on both sides of
the query's own score; a ring that lies ahead of that score as a whole is counted from its
size. Queries travel packed to the rings they visit, and to no other.

Bounds are widened by more than rounding can move a score, so results equal those of
comparing every query with every centroid.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.functions import vectors as vec
from featurelens.functions.hashing import seeded_key
from featurelens.functions.ranking import sorted_index
from featurelens.session import adapt, materialise

#: Pivots at most; with few centroids there are four times their square root.
PIVOTS = 256
#: Bytes of the centroids of a ring.
RING_BYTES = 1 << 20
#: Rings at most: beyond that rings hold more bytes, so the list sent to tasks stays bounded.
RINGS = 1 << 14
#: Bytes of the bounds that a task computes at once.
BOUND_BYTES = 16 << 20
#: What rounding may change, relative to the squared scale of the vectors, and at least.
SLACK, LEAST = 1e-6, 1e-11


@dataclass
class Rings:
    """The pivots and, per ring, its number, pivot, distances from the pivot and size."""

    pivots: np.ndarray
    block: np.ndarray
    pivot: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    size: np.ndarray
    length: float  # of the longest centroid
    cosine: bool

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Highest and lowest possible score of a member of each ring, and the slack of each query."""
        norm = np.sqrt((queries**2).sum(axis=1))
        unit = queries / np.where(norm > 0, norm, 1)[:, None] if self.cosine else queries
        square = (unit**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * unit @ self.pivots.T
        away = np.sqrt(np.maximum(square, 0))[:, self.pivot]
        low = np.maximum(0, np.maximum(away - self.farthest, self.nearest - away))
        high = away + self.farthest
        if self.cosine:
            slack = SLACK * norm + LEAST
            return norm[:, None] * (1 - low**2 / 2), norm[:, None] * (1 - high**2 / 2), slack
        return -(low**2), -(high**2), SLACK * (norm + self.length) ** 2 + LEAST

    def route(self, queries: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rings each query visits, and how many centroids of the others are ahead of its score."""
        best, worst, slack = self.bounds(queries)
        slack, own = slack[:, None], np.where(np.isnan(scores), np.inf, scores)[:, None]
        visit = best + slack >= worst.max(axis=1)[:, None]
        ahead = worst > own + slack
        visit |= ~ahead & ~(best < own - slack) & np.isfinite(own)
        if self.cosine:
            blank = ~queries.any(axis=1)
            visit[blank] = False
            visit[blank, 0] = True
            ahead[blank] = False
        return visit, np.where(ahead & ~visit, self.size, 0).sum(axis=1)


def _assign(pivots: np.ndarray):
    """Nearest pivot of each centroid and the distance to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = vec.matrix(batch, ["name"], "centre")
            square = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * rows @ pivots.T
            near = square.argmin(axis=1)
            away = np.sqrt(((rows - pivots[near]) ** 2).sum(axis=1))
            columns = [*batch.columns, pa.array(near.astype(np.int64)), pa.array(away)]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "centre", "pivot", "away"])

    return assign


def rings(centroids: DataFrame, cosine: bool, ring_bytes: int = RING_BYTES) -> tuple[DataFrame, Rings] | None:
    """``centroids`` (name, centre) with the number of their ring, and the list of rings."""
    adapt(centroids.sparkSession)
    found = centroids.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("centre")).alias("width"), F.max(vec.squared_norm("centre")).alias("top")
    ).first()
    if not found["n"]:
        return None
    count = min(PIVOTS, found["n"], 4 * math.isqrt(found["n"]))
    chosen = centroids.orderBy(seeded_key(0, "name"), "name").limit(count).collect()
    pivots = np.array([r["centre"] for r in chosen], float)
    kind = centroids.schema["name"].dataType.simpleString()
    assigned = centroids.select("name", "centre").mapInArrow(
        _assign(pivots), f"name {kind}, centre array<double>, pivot long, away double"
    )
    ring = max(1, ring_bytes // (8 * found["width"]), -(-found["n"] // (RINGS - count)))
    # Rings of a pivot are runs of its centroids by distance.
    ordered = sorted_index(materialise(assigned), ["pivot"], ["away", "name"], out="_at", bound=found["n"])
    numbered = materialise(
        ordered.select("name", "centre", "pivot", "away", (F.col("pivot") * RINGS + F.expr(f"_at div {ring}")).alias("_block"))
    )
    listed = numbered.groupBy("_block", "pivot").agg(
        F.min("away").alias("nearest"), F.max("away").alias("farthest"), F.count(F.lit(1)).alias("size")
    )
    rows = listed.orderBy("_block").collect()  # RINGS at most
    columns = {c: np.array([r[c] for r in rows]) for c in ("_block", "pivot", "nearest", "farthest", "size")}
    made = Rings(pivots, *columns.values(), math.sqrt(found["top"]), cosine)
    return numbered.select("_block", "name", "centre"), made


def _one_list(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def routed(found: Rings):
    """Rows ``key, id, score, vector`` to a packed row for each ring that some of them visit."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BOUND_BYTES // (8 * len(found.block)))
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                queries = vec.matrix(batch, batch.schema.names[:1], batch.schema.names[3])
                scores = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                visit, ahead = found.route(queries, scores)
                for ring in np.flatnonzero(visit.any(axis=0)):
                    rows = np.flatnonzero(visit[:, ring])
                    # What the rings not visited add is told on a query's first visit.
                    base = np.where(visit[rows].argmax(axis=1) == ring, ahead[rows], 0)
                    lists = [_one_list(c) for c in batch.select([0, 1, 2]).take(pa.array(rows)).columns]
                    packed = pa.array([np.ascontiguousarray(queries[rows]).tobytes()], pa.binary())
                    columns = [pa.array([int(found.block[ring])]), *lists, _one_list(pa.array(base)), packed]
                    yield pa.RecordBatch.from_arrays(columns, names=["_block", "_keys", "_ids", "_scores", "_base", "_x"])

    return route


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of one ring in a batch of ``_block, name, centre`` as a row."""
    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                part = batch.slice(a, b - a)
                centres = np.ascontiguousarray(vec.matrix(part, ["name"], "centre")).tobytes()
                columns = [pa.array([int(block[a])]), _one_list(part.column(1)), pa.array([centres], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["_block", "_names", "_c"])
