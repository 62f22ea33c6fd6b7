"""Word tables of Arrow text batches, built with whole-array NumPy steps.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; a null text has none. The
64-bit word keys are polynomial in the bytes and mixed, equal words have equal keys, and
nothing depends on how rows are batched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Odd multiplier of the polynomial keys and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that one set of NumPy arrays covers; longer texts form a block of their own.
BLOCK_BYTES = 1 << 19

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """``base ** 0 .. count - 1`` modulo 2**64, kept per process and doubled on demand."""
    have = _POWERS.get(base)
    if have is None or len(have) < count:
        size = max(count, 1 << 16, 2 * len(have) if have is not None else 0)
        have = np.full(size, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:count]


def mix(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit keys whose bits all depend on each other."""
    keys = keys ^ (keys >> np.uint64(30))
    keys = keys * np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(27)
    keys *= np.uint64(0x94D049BB133111EB)
    keys ^= keys >> np.uint64(31)
    return keys


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its ``n + 1`` offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if buffers[2] is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(batch: pa.RecordBatch, name: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts together stay near ``limit`` bytes."""
    if not batch.num_rows:
        return
    _, offsets = raw(batch.column(batch.schema.get_field_index(name)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


@dataclass
class Words:
    """Words of the documents of a block, in text order."""

    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of each document in data
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # past its last byte
    first: np.ndarray  # index of each document's first word; n + 1 entries
    key: np.ndarray  # uint64 key of each word

    @property
    def doc(self) -> np.ndarray:
        """Document number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def table(column: pa.Array, lower: bool = False) -> Words:
    """The words of a string array; ``lower`` folds A-Z first."""
    data, offsets = raw(column)
    if lower:
        data = LOWER[data]
    return of_bytes(data, offsets)


def of_bytes(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(IS_SPACE[data], out=inside[1 : n + 1])
    begins = inside[1 : n + 2] & ~inside[: n + 1]
    ends = inside[: n + 1] & ~inside[1 : n + 2]
    # A document boundary between two word bytes ends one word and begins the next.
    cuts = offsets[(offsets > 0) & (offsets < n)]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    begins[cuts] = True
    ends[cuts] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    first = np.searchsorted(start, offsets)
    return Words(data, offsets, start, end, first, span_keys(data, start, end))


def prefix_keys(data: np.ndarray) -> np.ndarray:
    """``n + 1`` running sums of byte times power of BASE."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    return sums


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Key of each byte span; equal bytes give equal keys wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    if sums is None:
        sums = prefix_keys(data)
    keys = (sums[end] - sums[start]) * powers(BASE_INVERSE, int(start[-1] if start[-1] >= start[0] else start.max()) + 1)[start]
    return mix(keys)


def shingle_keys(key: np.ndarray, width: int) -> np.ndarray:
    """Key of the ``width`` words that begin at each word, ``len(key) - width + 1`` of them."""
    n = len(key) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = key[:n].copy()
    for step in range(1, width):
        total *= np.uint64(BASE)
        total += key[step : step + n]
    return mix(total)


def spread(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[begin : begin + size]`` of all spans in a row."""
    total = int(sizes.sum())
    jump = np.ones(total, np.int64)
    full = sizes > 0
    b, s = begins[full], sizes[full]
    if not len(s):
        return values[:0]
    heads = np.cumsum(s) - s
    jump[heads[0]] = b[0]
    jump[heads[1:]] = b[1:] - (b[:-1] + s[:-1] - 1)
    return values[np.cumsum(jump)]


def filtered(docs: DataFrame, text: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose texts ``keep`` accepts, with all their columns.

    Inside the batches columns go by position, so that any names may be present.
    """
    names, at, schema = docs.columns, docs.columns.index(text), docs.schema

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for block in blocks(numbered, f"c{at}"):
                yield block.filter(pa.array(keep(block.column(at)), pa.bool_())).rename_columns(names)

    return docs.mapInArrow(passing, schema)
