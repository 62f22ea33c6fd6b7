"""Vector columns as NumPy matrices, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str | Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def usual_width(vectors: DataFrame, column: str = "vector") -> int:
    """Most frequent length of the vectors, the longest of equally frequent ones; 0 without any."""
    sizes = vectors.groupBy(F.size(column).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("width")).first()
    return top["width"] if top else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array without nulls, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def lists(values: np.ndarray) -> pa.Array:
    """A list array of a matrix's rows."""
    offsets = np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(values).ravel())
