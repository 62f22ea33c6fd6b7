"""Quality rules: word counts of a text and compression bands (zstandard).

Per text, with words ``[^\\x20\\x09-\\x0D]+`` (a null text has none):

``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of
``#*$%&|<>``), ``n_dup_lines`` (lines with a word that equal an earlier line),
``n_repeat_words`` (words in 8-word windows found twice or more in the text),
``base_failed`` (under 20 words, or more than 30 % of them repeated), ``ratio`` and
``low_chunk`` / ``high_chunk`` (compressed / raw bytes of the whole text and of its most
and least compressible chunk; null for a text without bytes) and ``kept``.

A text is rejected as repetitive when a ratio falls below the lower limit of its length
and as incompressible when one rises above the upper limit; short inputs carry the frame's
fixed cost and long ones find more matches, so limits are given at band ends and run
evenly in the logarithm of the length between them. Lower limits lie below ordinary prose,
markup and source code, not only below the labelled documents. Nulls and empty texts are not kept.
Rows are judged alone: repeated rows give repeated results, an empty table an empty one,
and columns beside the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurelens.llm import words
from featurelens.session import adapt

LEVEL = 3
CHUNK = 4096
#: End of a length band in bytes, then the lowest and highest accepted ratio there.
DOCUMENT_BANDS = (
    (128, 0.50, 1.15),
    (256, 0.42, 1.02),
    (512, 0.33, 0.88),
    (1024, 0.28, 0.80),
    (2048, 0.24, 0.74),
    (4096, 0.20, 0.70),
    (16384, 0.17, 0.66),
    (65536, 0.14, 0.64),
    (262144, 0.10, 0.62),
)
CHUNK_BANDS = ((2048, 0.10, 0.72), (4096, 0.08, 0.72), (6144, 0.08, 0.66))

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = np.zeros(256, dtype=np.int64)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        *(T.StructField(n, T.DoubleType()) for n in ("ratio", "low_chunk", "high_chunk")),
    ]
)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between each pair of neighbouring offsets."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Whether each key is found twice or more."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def repeated_words(w: words.Words, width: int = WINDOW) -> np.ndarray:
    """Per document, the words inside windows of ``width`` words found more than once."""
    count = np.diff(w.first)
    if len(w.key) < width:
        return np.zeros(len(count), np.int64)
    doc = w.doc
    keys = words.shingle_keys(w.key, width)
    n = len(keys)
    whole = doc[:n] == doc[width - 1 :]
    at = np.flatnonzero(whole)
    twice = at[_repeats(words.mix(keys[at] ^ words.mix(doc[at].astype(np.uint64) + np.uint64(1))))]
    step = np.zeros(len(w.key) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + width, -1)
    return _sums(np.cumsum(step[:-1]) > 0, w.first)


def duplicate_lines(w: words.Words) -> np.ndarray:
    """Per document, the lines with a word that equal an earlier line."""
    n = len(w.offsets) - 1
    breaks = np.flatnonzero(w.data == 10)
    starts = np.unique(np.concatenate((w.offsets[:-1], breaks + 1)))
    starts = starts[starts < len(w.data)]
    if not len(starts):
        return np.zeros(n, np.int64)
    ends = np.append(starts[1:], len(w.data))
    ends = ends - (w.data[ends - 1] == 10)
    worded = np.searchsorted(w.start, starts) < np.searchsorted(w.start, ends)
    starts, ends = starts[worded], ends[worded]
    if not len(starts):
        return np.zeros(n, np.int64)
    doc = np.searchsorted(w.offsets, starts, side="right") - 1
    keys = words.span_keys(w.data, starts, ends) ^ (ends - starts).astype(np.uint64)
    keys = words.mix(keys ^ words.mix(doc.astype(np.uint64) + np.uint64(1)))
    distinct = np.unique(keys, return_index=True)[1]
    return np.bincount(doc, minlength=n) - np.bincount(doc[distinct], minlength=n)


def _limits(bands, size: int) -> tuple[float, float]:
    """Lowest and highest accepted ratio of a length; constant before the first and after the last end."""
    before, *after = bands
    if size <= before[0]:
        return before[1:]
    for end in after:
        if size <= end[0]:
            part = log2(size / before[0]) / log2(end[0] / before[0])
            return before[1] + part * (end[1] - before[1]), before[2] + part * (end[2] - before[2])
        before = end
    return before[1:]


def chunks(size: int, chunk: int = CHUNK) -> list[tuple[int, int]]:
    """Fixed chunks of a text; a tail under half a chunk belongs to the chunk before it."""
    cuts = list(range(0, size, chunk))
    if len(cuts) > 1 and size - cuts[-1] < chunk // 2:
        cuts.pop()
    return list(zip(cuts, [*cuts[1:], size], strict=True))


def judge(text: bytes, compressor) -> tuple[float, float, float, bool]:
    """Ratio of the text, least and greatest ratio of its chunks, and the verdict."""
    size = len(text)
    ratio = len(compressor.compress(text)) / size
    low, high = _limits(DOCUMENT_BANDS, size)
    good = low <= ratio <= high
    if size < CHUNK + CHUNK // 2:
        return ratio, ratio, ratio, good
    ratios = []
    for a, b in chunks(size):
        ratios.append(len(compressor.compress(text[a:b])) / (b - a))
        low, high = _limits(CHUNK_BANDS, b - a)
        good = good and low <= ratios[-1] <= high
    return ratio, min(ratios), max(ratios), good


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of a block of texts, by name."""
    w = words.table(texts)
    n_words = np.diff(w.first)
    inside = np.cumsum(np.bincount(w.start, minlength=len(w.data) + 1) - np.bincount(w.end, minlength=len(w.data) + 1))[: len(w.data)]
    repeat = repeated_words(w)
    out = {
        "n_words": n_words,
        "word_chars": _sums((inside > 0) & ((w.data & 0xC0) != 0x80), w.offsets),
        "n_symbols": _sums(SYMBOLS[w.data], w.offsets),
        "n_dup_lines": duplicate_lines(w),
        "n_repeat_words": repeat,
        "base_failed": (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words),
    }
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    found = np.full((len(n_words), 4), np.nan)
    view = w.data.tobytes()
    for i in range(len(n_words)):
        a, b = int(w.offsets[i]), int(w.offsets[i + 1])
        found[i] = judge(view[a:b], compressor) if b > a else (np.nan, np.nan, np.nan, 0)
    out["kept"] = ~out["base_failed"] & (found[:, 3] > 0)
    for j, name in enumerate(("ratio", "low_chunk", "high_chunk")):
        out[name] = found[:, j]
    return out


def _assess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in words.blocks(batch):
            columns = [block.column(0)]
            for name, values in measures(block.column(1)).items():
                columns.append(pa.array(values, mask=np.isnan(values) if values.dtype.kind == "f" else None))
            yield pa.RecordBatch.from_arrays(columns, names=SCHEMA.names)


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its ``doc_id``, the measures and the verdict."""
    adapt(docs.sparkSession)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(_assess, SCHEMA)


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes the rules, with all their columns."""
    adapt(docs.sparkSession)
    return words.filtered(docs, text, lambda texts: measures(texts)["kept"])
