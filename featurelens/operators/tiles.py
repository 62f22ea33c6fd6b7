"""Covariance of wide features in tiles, and the leading part of its spectrum.

A D x D matrix of wide features fits no task. Rows are centred and cut into column tiles;
a pair of tiles is a key of its own, its product is folded by the tasks that hold the pair,
and the matrix stays a table of tile strips. Sums over the spectrum come from the strips;
leading eigenvalues from block subspace iteration, each step of which multiplies the
strips by a D x k block and returns one of that size. ``moments.gram`` and
``spectral_stats`` remain the way for features below a few thousand dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.functions import vectors as vec
from featurelens.session import adapt, stored

#: Columns of a tile.
TILE = 1024
#: Bytes of the rows that are cut into pairs at once, and of the products a task holds.
ROW_BYTES = 4 << 20
HELD_BYTES = 256 << 20
#: Extra directions of the iterated block, the residual at which it stops, and steps at most.
EXTRA, TOLERANCE, STEPS = 8, 1e-7, 100

_PAIRS = "row_tile int, column_tile int, salt int, left binary, right binary"
_STRIPS = "row_tile int, column_tile int, `row` long, products array<double>"


def _pairs(mean: np.ndarray, tile: int, salts: int):
    """Each block of rows to the pairs of its column tiles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, ROW_BYTES // (8 * len(mean)))
        made = 0
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                rows = vec.matrix(whole.slice(first, step), width=len(mean)) - mean
                pieces = [np.ascontiguousarray(rows[:, a : a + tile]).tobytes() for a in range(0, len(mean), tile)]
                made += 1
                for i, left in enumerate(pieces):
                    for j in range(i, len(pieces)):
                        numbers = (pa.array([x], pa.int32()) for x in (i, j, made % salts))
                        # A tile paired with itself travels once.
                        columns = [*numbers, pa.array([left]), pa.array([pieces[j] if j > i else None], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["row_tile", "column_tile", "salt", "left", "right"])

    return cut


def _folded(width: int, tile: int):
    """Products of tile pairs, added up, as one row per matrix row and column tile."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for (i, j), products in held.items():
                n = len(products)
                offsets = pa.array(np.arange(0, products.size + 1, products.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, i, np.int32)),
                        pa.array(np.full(n, j, np.int32)),
                        pa.array(np.arange(n) + i * tile),
                        pa.ListArray.from_arrays(offsets, pa.array(products.ravel())),
                    ],
                    names=["row_tile", "column_tile", "row", "products"],
                )
            held.clear()

        for batch in batches:
            for i, j, _, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = np.frombuffer(left).reshape(-1, min(tile, width - i * tile))
                b = a if right is None else np.frombuffer(right).reshape(-1, min(tile, width - j * tile))
                products = a.T @ b
                held[i, j] = held[i, j] + products if (i, j) in held else products
                if sum(p.nbytes for p in held.values()) > HELD_BYTES:
                    yield from emit()
        yield from emit()

    return fold


def tiled_covariance(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Population covariance of ``features`` as stored strips ``row_tile, column_tile, row, values``.

    Only tiles on and above the diagonal are there; ``values`` are the row's entries in the
    columns of ``column_tile``. Rows of null or unequal vectors are refused.
    """
    spark = adapt(df.sparkSession)
    rows = df.select(vec.as_doubles("features").alias("features"))
    if rows.isEmpty():
        raise ValueError("cannot take the covariance of an empty table")
    top = rows.agg(F.count(F.lit(1)).alias("n"), vec.means("features").alias("mean")).first()
    mean = np.array(top["mean"])  # one vector
    count = -(-len(mean) // tile)
    pairs = count * (count + 1) // 2
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(pairs, 1 << 12))
    salts = -(-parts // pairs)
    cells = rows.mapInArrow(_pairs(mean, tile, salts), _PAIRS).repartition(parts, "row_tile", "column_tile", "salt")
    strips = cells.mapInArrow(_folded(len(mean), tile), _STRIPS)
    summed = strips.groupBy("row_tile", "column_tile", "row").agg(vec.sums("products").alias("products"))
    return stored(
        summed.select("row_tile", "column_tile", "row", vec.divided("products", F.lit(float(top["n"]))).alias("values")), "tiles"
    )


def power_sums(strips: DataFrame, tile: int = TILE) -> DataFrame:
    """``trace`` and ``squares``: sums of the eigenvalues and of their squares."""
    diagonal = F.col("row_tile") == F.col("column_tile")
    own = F.element_at("values", (F.col("row") - F.col("column_tile") * tile + 1).cast("int"))
    return strips.agg(
        F.sum(F.when(diagonal, own)).alias("trace"),
        F.sum(vec.squared_norm("values") * F.when(diagonal, 1).otherwise(2)).alias("squares"),
    )


def _times(block: np.ndarray, tile: int):
    """Partial rows of the matrix times ``block``, one set per task."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros_like(block)
        hit = np.zeros(len(block), bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            i, j, row = (batch.column(c).to_numpy() for c in range(3))
            for at in np.unique(j):
                mine = np.flatnonzero(j == at)
                part = batch.take(pa.array(mine))
                values = vec.matrix(part, column="values")
                columns = slice(int(at) * tile, int(at) * tile + values.shape[1])
                out[row[mine]] += values @ block[columns]
                hit[row[mine]] = True
                above = i[mine] < at  # the mirrored tile below the diagonal
                if above.any():
                    out[columns] += values[above].T @ block[row[mine][above]]
                    hit[columns] = True
        rows = np.flatnonzero(hit)
        if len(rows):
            offsets = pa.array(np.arange(0, len(rows) * block.shape[1] + 1, block.shape[1], dtype=np.int32))
            values = pa.ListArray.from_arrays(offsets, pa.array(out[rows].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(rows), values], names=["row", "values"])

    return multiply


def leading_spectrum(
    strips: DataFrame, components: int, tile: int = TILE, tolerance: float = TOLERANCE, steps: int = STEPS, seed: int = 0
) -> DataFrame:
    """Largest eigenvalues ``component, eigenvalue, residual``, most first.

    ``residual`` is the length of ``C v - value v``, so an eigenvalue of the matrix lies
    within it of the value. Steps end when the greatest one falls below ``tolerance`` times
    the first value. The driver holds blocks of width x (components + EXTRA).
    """
    width = strips.agg(F.max("row")).first()[0] + 1
    size = min(width, components + EXTRA)
    keep = min(components, width)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    values = residual = np.zeros(keep)
    for _ in range(steps):
        partial = strips.select("row_tile", "column_tile", "row", "values").mapInArrow(_times(block, tile), "`row` long, values array<double>")
        product = np.zeros_like(block)
        for r in partial.groupBy("row").agg(vec.sums("values").alias("values")).collect():
            product[r["row"]] = r["values"]
        inner = block.T @ product
        found, turn = np.linalg.eigh((inner + inner.T) / 2)
        turn = turn[:, ::-1]
        values = found[::-1][:keep]
        residual = np.linalg.norm(product @ turn[:, :keep] - block @ turn[:, :keep] * values, axis=0)
        if residual.max() <= tolerance * max(values[0], np.finfo(float).tiny):
            break
        block = np.linalg.qr(product @ turn)[0]
    rows = [(i + 1, float(v), float(e)) for i, (v, e) in enumerate(zip(values, residual, strict=True))]
    return strips.sparkSession.createDataFrame(rows, "component int, eigenvalue double, residual double")
