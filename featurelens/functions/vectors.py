"""Expressions over array<double> vectors and sums of them."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_doubles(vector) -> Column:
    return _col(vector).cast("array<double>")


def vector_width(df: DataFrame, column: str = "features") -> int:
    """Length of the vectors, read from one row."""
    row = df.select(F.size(column).alias("width")).first()
    if row is None:
        raise ValueError("cannot take the width of an empty table")
    return row["width"]


def total(vector) -> Column:
    return F.aggregate(_col(vector), F.lit(0.0), lambda acc, x: acc + x)


def dot(left, right) -> Column:
    return total(F.zip_with(_col(left), _col(right), lambda a, b: a * b))


def squared_norm(vector) -> Column:
    return F.aggregate(_col(vector), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(vector) -> Column:
    return F.sqrt(squared_norm(vector))


def cosine(left, right) -> Column:
    """Cosine similarity; null when either vector is zero."""
    scale = norm(left) * norm(right)
    return F.when(scale > 0, dot(left, right) / scale)


def minus(left, right) -> Column:
    return F.zip_with(_col(left), _col(right), lambda a, b: a - b)


def plus(left, right) -> Column:
    return F.zip_with(_col(left), _col(right), lambda a, b: a + b)


def divided(vector, by) -> Column:
    by = _col(by)
    return F.transform(_col(vector), lambda x: x / by)


def normalise_input(vector, mean: float = 0.5, std: float = 0.5) -> Column:
    """Shift and scale every element."""
    return F.transform(_col(vector), lambda x: (x - F.lit(mean)) / F.lit(std))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def layer_norm(vector, eps: float = 1e-5) -> Column:
    """Centre a vector and divide by its own population spread."""
    vector = _col(vector)

    def scaled(centred):
        spread = F.sqrt(squared_norm(centred) / F.size(centred) + F.lit(eps))
        return let(spread, lambda s: F.transform(centred, lambda x: x / s))

    def centre(mean):
        return let(F.transform(vector, lambda x: x - mean), scaled)

    return let(total(vector) / F.size(vector), centre)


def prediction_error(predicted, target, exponent: float = 1.0) -> Column:
    """Mean over dimensions of |p - t|^e / e."""
    gaps = F.zip_with(
        _col(predicted),
        _col(target),
        lambda p, t: F.pow(F.abs(p - t), F.lit(exponent)) / F.lit(exponent),
    )
    return total(gaps) / F.size(_col(predicted))


def whole(vector, width: int | None = None) -> Column:
    """``vector``, or an error if it is null or, given a width, of another length.

    Aggregates are over rectangular features only: a missing or short row is a fault of
    the input and never counts as zeros.
    """
    vector = _col(vector)
    fits = vector.isNotNull() if width is None else F.coalesce(F.size(vector), F.lit(-1)) == width
    wanted = "a vector" if width is None else f"a vector of {width} elements"
    found = F.coalesce(vector.cast("string"), F.lit("null"))
    return F.when(fits, vector).otherwise(F.raise_error(F.concat(F.lit(f"expected {wanted}, found "), found)))


def _vector(column) -> Column:
    return array_to_vector(as_doubles(whole(column)))


# Up to this width flat per-element aggregates beat the summariser's object buffers. Both
# ways refuse null and unequal vectors.
NARROW = 32


def _per_element(aggregate, column, width) -> Column:
    vector = whole(column, width)
    gap = F.raise_error(F.concat(F.lit("expected a vector without gaps, found "), _col(column).cast("string")))
    return F.array(*[aggregate(F.coalesce(vector[i].cast("double"), gap.cast("double"))) for i in range(width)])


def matrix(batch, keys=(), column: str = "features", width: int | None = None):
    """The vectors of an Arrow batch as rows of a matrix; null and unequal ones raise."""
    vectors = batch.column(column)
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    expected = width if width is not None else (sizes[0] if len(sizes) else 0)
    wrong = np.flatnonzero(sizes != expected) if expected >= 0 else np.zeros(1, int)
    values = vectors.flatten()
    if len(wrong) or values.null_count:
        row = int(wrong[0]) if len(wrong) else next(
            i for i, v in enumerate(vectors.to_pylist()) if any(x is None for x in v)
        )
        where = {k: batch.column(k)[row].as_py() for k in keys} or row
        raise ValueError(f"expected a vector of {expected} elements, found {vectors[row].as_py()} at {where}")
    return values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def sums(column, width: int | None = None) -> Column:
    """Element-wise sum of a vector column, an aggregate.

    The summariser keeps one flat buffer per group on the JVM and combines on the map
    side, so vectors are neither exploded nor spread over one column per element. Give
    the ``width`` of narrow vectors to use plain hash aggregation instead.
    """
    if width is not None and width <= NARROW:
        return _per_element(F.sum, column, width)
    return vector_to_array(Summarizer.sum(_vector(column)))


def means(column, width: int | None = None) -> Column:
    if width is not None and width <= NARROW:
        return _per_element(F.avg, column, width)
    return vector_to_array(Summarizer.mean(_vector(column)))


def deviations(column) -> Column:
    """Element-wise population standard deviation, an aggregate."""
    rows = F.count(F.lit(1))
    sample = vector_to_array(Summarizer.std(_vector(column)))
    return divided(sample, F.sqrt(rows / F.greatest(rows - 1, F.lit(1))))


def literal(values) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(v)) for v in values])
