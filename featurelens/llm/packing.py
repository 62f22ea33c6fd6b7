"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A document's tokens are its tokenizer ids and a final end id. Tokens beyond whole sequences
are cut into at most ``MAX_PIECES`` pieces: a piece that nearly fills a share ``capacity / j``
stays whole, else the largest share that fits is cut off. A piece of length ``n`` is of
class ``j = capacity // n``, and each sequence of class ``j`` takes exactly ``j`` pieces, so
a worker numbers its pieces of a class without looking at other workers: only the counts
per (class, worker) are added up. The last sequence of each class may stay short.

A null text is empty and still has its end id; repeated rows are packed each; null ids are
kept; an empty table packs into nothing; columns beside id and text are not read by
``cut``, and ``place`` passes extra columns of the pieces on.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelens.llm import ordered, words
from featurelens.session import adapt, stored

CAPACITY = 2048
END_ID = 1
MAX_PIECES = 3
#: Share of a piece's length that may be left empty before it is cut instead.
MAX_SLACK = 1 / 32
#: Distinct words whose ids a worker remembers.
REMEMBERED = 1 << 20
#: Words given to the tokenizer in one call.
AT_ONCE = 1 << 13

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_TAIL = np.zeros(256, dtype=bool)
_TAIL[[ord(c) for c in ".,;:!?|"]] = True


#: The tokenizer of this worker process, by file and its time of change.
_OWN: dict[tuple, "WordTokenizer"] = {}


def tokenizer_of(path: str) -> "WordTokenizer":
    """One tokenizer per worker process: later tasks find the words of earlier ones."""
    key = (path, os.stat(path).st_mtime_ns)
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = WordTokenizer(path)
    return _OWN[key]


class WordTokenizer:
    """Ids of whole texts from the ids of their words.

    Valid for tokenizers that drop white space and never merge across it, nor across a
    letter or digit and the mark that ends a word; A-Z are folded for words of ASCII alone.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        found = []
        for a in range(0, len(texts), AT_ONCE):  # encodings are large beside their ids
            some = self.tokenizer.encode_batch_fast(texts[a : a + AT_ONCE], add_special_tokens=False)
            found += [e.ids for e in some]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
        all_keys = np.concatenate((self.keys, keys))
        all_sizes = np.concatenate((np.diff(self.first), sizes))
        begins = np.concatenate((self.first[:-1], len(self.ids) + np.cumsum(sizes) - sizes))
        order = np.argsort(all_keys, kind="stable")
        self.ids = words.spread(np.concatenate((self.ids, flat)), begins[order], all_sizes[order])
        self.keys = all_keys[order]
        self.first = np.concatenate(([0], np.cumsum(all_sizes[order])))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and ``n + 1`` offsets of each text's ids."""
        data, offsets = words.raw(texts)
        w = words.of_bytes(data, offsets)
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        # Words with other letters, or that may hold a special token, keep their case.
        special = np.concatenate(([0], np.cumsum((data >= 0x80) | (data == ord("<")))))
        plain = special[w.end] == special[w.start]
        fold = np.zeros(len(data) + 1, np.int8)
        fold[w.start[plain]] += 1  # starts are distinct, and so are ends
        fold[w.end[plain]] -= 1
        folded = np.where(np.cumsum(fold[:-1]) > 0, words.LOWER[data], data)
        # A final mark after a letter or digit is a piece of its own.
        before = folded[np.maximum(w.end - 2, 0)]
        tail = (w.end - w.start > 1) & _TAIL[folded[w.end - 1]] & _ALNUM[before]
        start = np.concatenate((w.start, w.end[tail] - 1))
        end = np.concatenate((w.end - tail, w.end[tail]))
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        keys = words.span_keys(folded, start, end)
        distinct, where, which = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.remembered:
                known[:] = False
                self._forget()
            new = where[~known]
            self._learn(folded, keys[new], start[new], end[new])
            at = np.searchsorted(self.keys, distinct)
        at = at[which]
        sizes = np.diff(self.first)[at]
        ids = words.spread(self.ids, self.first[at], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return ids, ends[np.searchsorted(start, offsets)]


def lengths(tokens: int, capacity: int = CAPACITY, pieces: int = MAX_PIECES, slack: float = MAX_SLACK) -> list[int]:
    """Piece lengths of a document of ``tokens`` tokens, in order."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    for left in range(pieces, 0, -1):
        if not rest:
            break
        share = capacity // (capacity // rest)
        if left == 1 or share - rest <= slack * rest:
            out.append(rest)
            break
        # The largest share capacity // j that is at most the rest.
        cut = capacity // -(-capacity // rest)
        out.append(cut)
        rest -= cut
    return out


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
#: Bytes of text tokenised at once, so that words are looked up together.
TOKEN_BLOCK = 1 << 20


def cut(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents; ``ids`` are little-endian unsigned 32-bit integers.

    ``tokenizer`` is a file that every worker can read.
    """
    adapt(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = tokenizer_of(tokenizer)
        for batch in batches:
            for block in words.blocks(batch, limit=TOKEN_BLOCK):
                ids, first = words_of.encode(block.column(1))
                out: list[list] = [[], [], [], [], []]
                for row, doc in enumerate(block.column(0).to_pylist()):
                    own = np.append(ids[first[row] : first[row + 1]], np.uint32(END_ID)).astype("<u4")
                    start = 0
                    for length in lengths(len(own), capacity):
                        for column, value in zip(
                            out, (doc, start, length, len(own), own[start : start + length].tobytes()), strict=True
                        ):
                            column.append(value)
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(pieces, PIECES)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs doc_id, start, length, doc_tokens."""
    worker = stored(pieces.withColumn(ordered.PART, F.spark_partition_id()), "pieces")
    sized = worker.withColumn("__class", F.expr(f"{capacity} div length"))
    counts = sized.groupBy("__class", ordered.PART).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__class").orderBy(ordered.PART)
    before = counts.select(
        "__class",
        ordered.PART,
        (F.sum("n").over(earlier) - F.col("n")).alias("__before"),
    )
    # At most one row per class, and there are fewer than 2 * sqrt(capacity) of them.
    bins = counts.groupBy("__class").agg(F.sum("n").alias("n")).withColumn("bins", F.expr("(n + __class - 1) div __class"))
    bases = bins.select("__class", (F.sum("bins").over(Window.orderBy("__class")) - F.col("bins")).alias("__base"))
    own = Window.partitionBy(ordered.PART, "__class").orderBy("doc_id", "start", "doc_tokens")
    ranked = (
        sized.withColumn("__nth", F.row_number().over(own))
        .join(before, ["__class", ordered.PART])
        .withColumn("__rank", F.col("__before") + F.col("__nth") - 1)
        .join(F.broadcast(bases), "__class")
        .withColumn("sequence_id", F.expr("__base + __rank div __class"))
    )
    filled = Window.partitionBy("sequence_id").orderBy("__rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("offset", F.sum("length").over(filled) - F.col("length")).select(
        *pieces.columns, "sequence_id", "offset"
    )


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their ids, sequence and offset."""
    return place(cut(docs, tokenizer, key, text, capacity), capacity)


def placements(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """As ``pack``, with a CRC-32 in place of the ids, so that only narrow rows move."""
    pieces = cut(docs, tokenizer, key, text, capacity).withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
    return place(pieces, capacity)
