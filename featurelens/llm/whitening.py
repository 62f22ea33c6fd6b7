"""Whitening of embeddings by shifted CholeskyQR.

Entries become integers ``floor(scale * c) + offset``, so counts, sums and centred rows are
exact. ``fit`` makes the centred rows orthogonal in passes over the table: a pass adds up
the Gram matrix of the rows as the factors found so far leave them (one triangular solve
per factor), and its Cholesky factor joins them. The first is shifted away from zero, as
later ones are where a plain factorisation breaks down; passes end when the Gram matrix is
a projection to working precision. The factors' product is R of the table, and the singular
values and right vectors of R are those of the rows: components and eigenvalues of the
covariance, without the digits that an eigensolver of the first Gram matrix would lose.
``transform`` projects every row.

Tasks pass on Gram entries, added up by entry in Spark; the driver and each task hold
matrices of width x width and nothing that follows the number of rows.

Rows whose vector is null, empty, or holds null or non-finite entries are left out, as are
vectors whose length is not the table's most frequent one (the longest of equals). Scaled
entries beyond 2**53 count as that. ``deviation`` is null where it exceeds a long.
Components without variance (constant or dependent columns, a single row, all rows alike)
have null ``whitened`` and a share of 0, null if nothing varies; fewer columns than
components give fewer components. Equal rows get equal results; null ids stay null; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.llm import dense
from featurelens.session import adapt, stored

SCALE = 1024.0
OFFSET = 100_000
COMPONENTS = 8
#: Passes at most; three suffice for any table that is not rank-deficient.
PASSES = 8
LIMIT = 2.0**53
EPS = float(np.finfo(np.float64).eps)
#: Bytes of rows that one set of NumPy arrays covers.
BLOCK_BYTES = 8 << 20
#: Bits of the low half of a scaled entry; halves are added up apart, so that sums stay exact.
HALF = 26
MOST = (1 << 63) - 1


@dataclass
class Whitening:
    """What a fitted table is centred with and projected on."""

    width: int
    n: int
    whole: np.ndarray  # floor(sum / n) of each column
    rest: list[int]  # sum - n * whole
    factors: list[np.ndarray] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))  # eigenvalues, falling
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # a column each
    shares: np.ndarray = field(default_factory=lambda: np.zeros(0))
    identity_error: float | None = None

    def centred(self, whole: np.ndarray) -> np.ndarray:
        return (whole - self.whole) - np.array(self.rest, np.float64) / self.n


def _prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    vectors = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("key"), vectors.alias("vector"))
    return rows.filter(dense.finite("vector"))


def scaled(values: np.ndarray, scale: float, offset: int) -> np.ndarray:
    return np.clip(np.floor(scale * values), -LIMIT, LIMIT).astype(np.int64) + offset


def solve(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverse of each upper triangular factor in turn."""
    for factor in factors:
        out = np.empty_like(rows)
        for j in range(rows.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
        rows = out
    return rows


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK_BYTES // (8 * width))
    for first in range(0, batch.num_rows, step):
        yield batch.slice(first, step)


def _totals(scale: float, offset: int):
    """Per task, length and column: rows and the sums of both halves of the scaled entries."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            widths = batch.column(0).value_lengths().to_numpy()
            for width in np.unique(widths).tolist():
                alike = batch.filter(pa.array(widths == width))
                for piece in _pieces(alike, width):
                    x = scaled(dense.matrix(piece.column(0), width), scale, offset)
                    held = sums.setdefault(width, [0, np.zeros(width, np.int64), np.zeros(width, np.int64)])
                    held[0] += len(x)
                    held[1] += (x >> HALF).sum(axis=0)
                    held[2] += (x & ((1 << HALF) - 1)).sum(axis=0)
        for width, (n, high, low) in sums.items():
            columns = [np.full(width, width), np.arange(width), np.full(width, n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_TOTALS_NAMES)

    return total


_TOTALS = "width long, dimension long, n long, high long, low long"
_TOTALS_NAMES = [c.split()[0] for c in _TOTALS.split(", ")]


def _started(rows: DataFrame, scale: float, offset: int) -> Whitening | None:
    """Length, number and exact means of the vectors; None without any."""
    parts = rows.select("vector").mapInArrow(_totals(scale, offset), _TOTALS)
    sums = stored(parts.groupBy("width", "dimension").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))), "whitening-sums")
    top = sums.filter("dimension = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if top is None:
        return None
    mine = sums.filter(F.col("width") == top["width"]).orderBy("dimension").collect()
    parted = [divmod((r["high"] << HALF) + r["low"], top["n"]) for r in mine]
    return Whitening(top["width"], top["n"], np.array([w for w, _ in parted], np.int64), [r for _, r in parted])


def _added(rows: DataFrame, width: int, view: Callable[[np.ndarray], np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and Gram matrix over all rows of ``view`` of each block of vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, gram = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            for piece in _pieces(batch, width):
                block = view(dense.matrix(piece.column(0), width))
                sums += block.sum(axis=0)
                gram += block.T @ block
        i, j = np.triu_indices(size)
        left = np.concatenate((np.full(size, -1), i))
        right = np.concatenate((np.arange(size), j))
        values = np.concatenate((sums, gram[i, j]))
        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(values)], names=["i", "j", "v"])

    parts = rows.select("vector").mapInArrow(add, "i long, j long, v double")
    sums, gram = np.zeros(size), np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r["i"] < 0:
            sums[r["j"]] = r["v"]
        else:
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["v"]
    return sums, gram


def cholesky(gram: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper factor of ``gram``, shifted by the least step with which it can be formed."""
    size = len(gram)
    shift = 11 * size * (size + 1) * EPS * max(np.linalg.norm(gram, 2), np.finfo(np.float64).tiny)
    step = shift if shifted else 0.0
    while True:
        try:
            factor = np.linalg.cholesky(gram + step * np.eye(size)).T
            if np.diag(factor).min() ** 2 > shift / 100:
                return factor
        except np.linalg.LinAlgError:
            pass
        step = max(10 * step, shift)


def _orthogonal(gram: np.ndarray) -> bool:
    values = np.linalg.eigvalsh(gram)
    return bool(np.all((np.abs(values - 1) < 1e-12) | (np.abs(values) < 1e-12)))


def fit(
    df: DataFrame,
    vector: str = "embedding",
    components: int = COMPONENTS,
    scale: float = SCALE,
    offset: int = OFFSET,
) -> Whitening | None:
    """Mean, components and eigenvalues of all usable vectors of ``df``; None without any."""
    adapt(df.sparkSession)
    rows = _prepared(df, vector, vector)
    model = _started(rows, scale, offset)
    if model is None:
        return None
    rows = rows.filter(F.size("vector") == model.width)

    def left(values: np.ndarray) -> np.ndarray:
        return solve(model.centred(scaled(values, scale, offset)), model.factors)

    _, gram = _added(rows, model.width, left, model.width)
    for _ in range(PASSES if gram.any() else 0):
        model.factors.append(cholesky(gram, shifted=not model.factors))
        _, gram = _added(rows, model.width, left, model.width)
        if _orthogonal(gram):
            break
    triangle = np.eye(model.width)
    for factor in model.factors:
        triangle = factor @ triangle
    # What the last Gram matrix still differs from a projection goes into R as its root.
    values, turns = np.linalg.eigh(gram)
    root = (turns * np.sqrt(np.where(values > 0.25, values, 0))) @ turns.T
    _, singular, right = np.linalg.svd(root @ triangle)
    keep = min(components, model.width)
    live = singular[:keep] > model.width * EPS * singular[0]
    spread = singular**2
    model.values = np.where(live, spread[:keep] / model.n, 0.0)
    model.components = right[:keep].T
    total = spread.sum()
    model.shares = np.where(live, spread[:keep] / total, 0.0) if total else np.full(keep, np.nan)

    seen = np.flatnonzero(live)
    if len(seen):
        sums, gram = _added(rows, model.width, lambda v: projected(model, scaled(v, scale, offset))[:, seen], len(seen))
        mean = sums / model.n
        model.identity_error = float(np.abs(gram / model.n - np.outer(mean, mean) - np.eye(len(seen))).max())
    return model


def projected(model: Whitening, whole: np.ndarray) -> np.ndarray:
    """Whitened rows; NaN in components without variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (model.centred(whole) @ model.components) / np.sqrt(model.values)
    out[:, model.values == 0] = np.nan
    return out


def deviations(model: Whitening, whole: np.ndarray) -> pa.Array:
    """Exact sums of squares of ``n * x - sum``; null beyond a long."""
    parts = model.n * (whole - model.whole).astype(np.float64) - np.array(model.rest, np.float64)
    about = (parts**2).sum(axis=1)
    safe = about < 0.9 * MOST
    small = (whole - model.whole)[safe] * np.int64(model.n) - np.array(model.rest, np.int64)
    out = np.zeros(len(whole), np.int64)
    out[safe] = (small**2).sum(axis=1)
    null = ~safe
    for i in np.flatnonzero(~safe & (about < 1.1 * MOST)):
        exact = sum((model.n * (int(x) - int(w)) - r) ** 2 for x, w, r in zip(whole[i], model.whole, model.rest, strict=True))
        if exact <= MOST:
            out[i], null[i] = exact, False
    return pa.array(out, mask=null)


def transform(
    df: DataFrame,
    model: Whitening | None,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """``key``, ``deviation`` and the array ``whitened`` of each usable row of ``df``."""
    adapt(df.sparkSession)
    rows = _prepared(df, key, vector)
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, deviation long, whitened array<double>"
    if model is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    rows = rows.filter(F.size("vector") == model.width)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, model.width):
                whole = scaled(dense.matrix(piece.column(1), model.width), scale, offset)
                out = projected(model, whole)
                flat = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
                offsets = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
                columns = [piece.column(0), deviations(model, whole), pa.ListArray.from_arrays(offsets, flat)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "deviation", "whitened"])

    return rows.mapInArrow(project, schema).withColumnRenamed("key", key)


def whiten(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    scale: float = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """One row per usable row of ``df`` and component, with the figures of the fit."""
    model = fit(df, vector, components, scale, offset)
    rows = transform(df, model, key, vector, scale, offset)
    shares = model.shares if model else np.zeros(0)
    shares = F.array(*(F.lit(None if np.isnan(s) else float(s)).cast("double") for s in shares)).cast("array<double>")
    error = model.identity_error if model else None
    return rows.select(key, "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        key,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained") if model else F.lit(None).cast("double").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
