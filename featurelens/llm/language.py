"""Scores of whole documents by a gated recurrent language model trained on Spark.

Words (A-Z folded) and one end per document are the tokens. All training documents are
counted; the most frequent words form a shortlist with places in a class-factored softmax,
every other word belongs to one of ``KINDS`` classes by its shape (length, letters beyond
ASCII, last character) and has, inside that class, the smoothed share of its count. The
model (see ``recurrent``) learns from every training document once, in ``ROUNDS`` rounds:
workers train from the same parameters on their share, and the parameters are averaged by
tokens. Scoring carries the state through the whole document.

What a task or the driver holds is bounded: parameters, and a lexicon of at most
``LEXICON`` words with their counts. Counts of rarer words are met by a join.

A null text is empty and consists of its end; a null id is hashed as an empty string;
repeated rows are scored each; without training documents all scores rest on empty counts;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurelens.llm import recurrent, words
from featurelens.session import adapt, stored

SHORTLIST = 1024
LEXICON = 1 << 18
KINDS = 32
ROUNDS = 5
#: Tokens that a worker trains on in a round at least, where there are so many.
SHARE = 1 << 19
#: Tokens trained on in one piece, so that a worker's memory does not follow its share.
PIECE = 1 << 21
#: Bytes of tokens that one set of NumPy arrays covers; longer documents form a set of their own.
TOKEN_BYTES = 1 << 19
#: Bytes of tokens whose documents are scored side by side.
POOL_BYTES = 8 << 20
SLICES = 16
#: Key of the end token; words have mixed keys.
END_KEY = np.uint64(0xE0D)

_STOP = np.zeros(256, np.int64)
_STOP[[ord(c) for c in ".?!"]] = 1
_STOP[[ord(c) for c in ",;:)|"]] = 2
_STOP[ord("0") : ord("9") + 1] = 3


def kinds(w: words.Words) -> np.ndarray:
    """Shape class of each word."""
    length = w.end - w.start
    wide = np.concatenate(([0], np.cumsum(w.data >= 0x80)))
    size = (length > 4).astype(np.int64) + (length > 7) + (length > 11)
    beyond = (wide[w.end] > wide[w.start]).astype(np.int64)
    last = _STOP[w.data[w.end - 1]] if len(w.end) else size
    return (size * 2 + beyond) * 4 + last


def _combined(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, kind, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
    return distinct, kind[first], np.bincount(which, weights=n, minlength=len(distinct)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts ``key, kind, n``; ends have the kind -1."""
    held: list = []
    size = docs = 0

    def out(part):
        return pa.RecordBatch.from_arrays(
            [pa.array(part[0].view(np.int64)), pa.array(part[1].astype(np.int32)), pa.array(part[2])], names=["key", "kind", "n"]
        )

    for batch in batches:
        for block in words.blocks(batch):
            w = words.table(block.column(0), lower=True)
            docs += block.num_rows
            if not len(w.key):
                continue
            held.append(_combined([(w.key, kinds(w), np.ones(len(w.key)))]))
            size += len(held[-1][0])
            if size > 1 << 20:
                held = [_combined(held)]
                size = len(held[0][0])
                if size > 1 << 19:
                    yield out(held[0])
                    held, size = [], 0
    if held:
        yield out(_combined(held))
    if docs:
        yield out((np.array([END_KEY]), np.array([-1]), np.array([docs])))


@dataclass
class Lexicon:
    """Frequent words: sorted keys, counts, and shortlist tokens (-1 where none)."""

    key: np.ndarray
    count: np.ndarray
    token: np.ndarray
    end: int  # token of the end
    tokens: int  # N
    distinct: int  # V
    kind_tokens: np.ndarray  # training tokens per kind, shortlist left out
    kind_words: np.ndarray  # distinct words per kind, shortlist left out
    end_count: int

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the lexicon, and whether each key is there."""
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key


@dataclass
class Sequence:
    """Token row of a block: documents end to end, each with its end token."""

    token: np.ndarray
    first: np.ndarray
    word_at: np.ndarray  # place of each word in the row


def sequence(w: words.Words, lexicon: Lexicon, at: np.ndarray, known: np.ndarray, shape: np.ndarray) -> Sequence:
    docs = len(w.first) - 1
    token = np.where(known, lexicon.token[at] if len(lexicon.token) else -1, -1)
    token = np.where(token < 0, (lexicon.token >= 0).sum() + 1 + shape, token)
    out = np.full(len(token) + docs, lexicon.end, np.int64)
    word_at = np.arange(len(token)) + w.doc
    out[word_at] = token
    return Sequence(out, w.first + np.arange(docs + 1), word_at)


def _rows(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of encoded batches with their tokens and the first token of each document."""
    for batch in batches:
        for block in words.blocks(batch, "tokens", TOKEN_BYTES):
            data, offsets = words.raw(block.column(block.num_columns - 1))
            yield block, data.view(kind).astype(np.int64), offsets // np.dtype(kind).itemsize


def _train(shared, rate: float, kind: str):
    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, lay, vector, squares = shared.value
        trainer = recurrent.Trainer(vector, squares, lay, rate)
        tokens, begins, held, seen = [], [], 0, 0

        def learn():
            trainer.learn(np.concatenate(tokens), np.concatenate(begins), end, lossy=False)
            tokens.clear()
            begins.clear()

        for _, row, first in _rows(batches, kind):
            begin = np.zeros(len(row), bool)
            begin[first[:-1]] = True
            tokens.append(row)
            begins.append(begin)
            held += len(row)
            seen += len(row)
            if held >= PIECE:
                learn()
                held = 0
        if held:
            learn()
        if seen:
            cut = np.linspace(0, len(vector), SLICES + 1).astype(int)
            for i in range(SLICES):
                part = slice(cut[i], cut[i + 1])
                yield _slice(i, float(seen), trainer.vector[part], trainer.squares[part])

    return trained


SLICE = "slice int, weight double, vector binary, squares binary"


def _slice(i: int, weight: float, vector: np.ndarray, squares: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i], pa.int32()),
            pa.array([weight]),
            pa.array([vector.astype(np.float32).tobytes()], pa.binary()),
            pa.array([squares.astype(np.float32).tobytes()], pa.binary()),
        ],
        names=["slice", "weight", "vector", "squares"],
    )


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means of the slices of all workers, one running sum per slice."""
    sums: dict[int, list] = {}
    for batch in batches:
        for i, weight, vector, squares in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = [weight, *(weight * np.frombuffer(x, np.float32).astype(np.float64) for x in (vector, squares))]
            sums[i] = [a + b for a, b in zip(sums[i], new, strict=True)] if i in sums else new
    for i, (weight, vector, squares) in sums.items():
        yield _slice(i, weight, vector / weight, squares / weight)


ENCODED = (
    "doc_id long, held_out boolean, turn int, n_tokens long, n_known long, base double, beside double,"
    " rare array<long>, rare_n array<long>, tokens binary"
)


def _binaries(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of ``values`` between neighbouring ``first`` as a binary array."""
    offsets = (first * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _encode(shared, kind: str):
    """All that follows from counts alone, and each document's tokens for the network.

    ``beside`` adds up what words outside the shortlist owe to their counts. Words outside
    the lexicon are listed: their counts are met by a join.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        shortlisted = int((lexicon.token >= 0).sum()) + 1
        total = lexicon.tokens + lexicon.distinct + 1
        in_kind = np.log10(lexicon.kind_tokens + lexicon.kind_words + 1.0)
        count = np.log10(lexicon.count + 1.0)
        for batch in batches:
            for block in words.blocks(batch):
                w = words.table(block.column(3), lower=True)
                docs, shape = block.num_rows, kinds(w)
                at, known = lexicon.look_up(w.key)
                row = sequence(w, lexicon, at, known, shape)
                own = np.where(known, count[at] if len(count) else 0.0, 0.0)
                other = row.token[row.word_at] >= shortlisted
                beside = np.bincount(w.doc, weights=np.where(other, own - in_kind[shape], 0.0), minlength=docs)
                base = np.bincount(w.doc, weights=own, minlength=docs) + np.log10(lexicon.end_count + 1.0)
                n_tokens = np.diff(row.first)
                n_known = np.bincount(w.doc, weights=known, minlength=docs).astype(np.int64)
                n_known += lexicon.end_count > 0
                rare = np.flatnonzero(~known)
                mixed = words.mix(w.key[rare] ^ words.mix(w.doc[rare].astype(np.uint64) + np.uint64(1)))
                _, first, times = np.unique(mixed, return_index=True, return_counts=True)
                order = np.argsort(first)
                rare, times = rare[first[order]], times[order]
                cut = pa.array(np.searchsorted(w.doc[rare], np.arange(docs + 1)).astype(np.int32))
                lists = (w.key[rare].view(np.int64), times)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(block.column(i) for i in range(3)),
                        pa.array(n_tokens),
                        pa.array(n_known),
                        pa.array(base - n_tokens * np.log10(total)),
                        pa.array(beside),
                        *(pa.ListArray.from_arrays(cut, pa.array(values)) for values in lists),
                        _binaries(row.token.astype(kind), row.first),
                    ],
                    names=[f.split()[0] for f in ENCODED.split(", ")],
                )

    return encoded


def _score(shared, kind: str):
    """``row, score`` of encoded documents; the state is carried through each of them."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, lay, vector, _ = shared.value
        model = recurrent.unpack(vector, lay)
        held: list[pa.RecordBatch] = []
        size = 0

        def pool() -> pa.RecordBatch:
            rows = np.concatenate([b.column(0).to_numpy() for b in held])
            parts = [words.raw(b.column(1)) for b in held]
            tokens = np.concatenate([data.view(kind) for data, _ in parts])
            sizes = np.concatenate([np.diff(offsets) for _, offsets in parts]) // np.dtype(kind).itemsize
            first = np.concatenate(([0], np.cumsum(sizes)))
            own = recurrent.document_scores(model, lay, tokens, first, end) / np.log(10)
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(own)], names=["row", "own"])

        for batch in batches:
            for block in words.blocks(batch, "tokens", TOKEN_BYTES):
                held.append(block)
                size += int(np.diff(words.raw(block.column(1))[1]).sum())
                if size >= POOL_BYTES:
                    yield pool()
                    held, size = [], 0
        if held:
            yield pool()

    return scored


def held_out(key: str, parts: int = 7, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the remainder kept for testing."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts == part


def lexicon_of(vocabulary: DataFrame, shortlist: int = SHORTLIST, limit: int = LEXICON) -> tuple[Lexicon, np.ndarray, int]:
    """Lexicon, counts of the model's tokens, and the least count that is in the lexicon."""
    counts = vocabulary.filter("kind >= 0").groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    # One row per distinct count; counts whose words all fit stay.
    upto = F.sum("words").over(Window.orderBy(F.desc("n")))
    least = counts.withColumn("upto", upto).filter(F.col("upto") <= limit).agg(F.min("n")).first()[0]
    least = least if least is not None else 1 << 62
    frequent = vocabulary.filter((F.col("kind") >= 0) & (F.col("n") >= least)).toArrow()
    key = frequent.column("key").to_numpy().view(np.uint64)
    n, kind = frequent.column("n").to_numpy(), frequent.column("kind").to_numpy()
    order = np.argsort(key)
    key, n, kind = key[order], n[order], kind[order]
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    end = vocabulary.filter("kind < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kind_tokens, kind_words = np.zeros(KINDS), np.zeros(KINDS)
    for row in vocabulary.filter("kind >= 0").groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("w")).collect():
        kind_tokens[row["kind"]], kind_words[row["kind"]] = row["n"], row["w"]
    # The shortlist in descending counts, the end among them.
    top = np.lexsort((key, -n))[: shortlist - 1]
    np.subtract.at(kind_tokens, kind[top], n[top])
    np.subtract.at(kind_words, kind[top], 1)
    place = int((n[top] >= end).sum())
    token = np.full(len(key), -1)
    token[top] = np.arange(len(top)) + (np.arange(len(top)) >= place)
    model_counts = np.concatenate((np.insert(n[top].astype(float), place, end), kind_tokens))
    made = Lexicon(key, n, token, place, int(total[0]), int(total[1]), kind_tokens, kind_words, int(end))
    return made, model_counts, int(least)


def train(encoded: DataFrame, lexicon: Lexicon, counts: np.ndarray, kind: str, rounds: int = ROUNDS, rate: float = recurrent.RATE):
    """Layout, parameters and AdaGrad sums after one pass over ``encoded`` (turn, tokens)."""
    context = encoded.sparkSession.sparkContext
    shortlist = counts[: len(counts) - KINDS]
    lay = recurrent.layout(shortlist, KINDS, max(recurrent.CLASSES, math.isqrt(len(shortlist))))
    vector = recurrent.start(counts, lay)
    squares = np.full(len(vector), 1e-4, np.float32)
    workers = max(1, -(-lexicon.tokens // (rounds * SHARE)))
    for turn in range(rounds):
        shared = context.broadcast((lexicon.end, lay, vector, squares))
        share = encoded.filter(F.col("turn") == turn).select("tokens")
        means = share.coalesce(workers).mapInArrow(_train(shared, rate, kind), SLICE).repartition("slice").mapInArrow(_mean, SLICE)
        parts = sorted(means.collect(), key=lambda r: r["slice"])
        if parts:
            vector, squares = (
                np.concatenate([np.frombuffer(r[c], np.float32) for r in parts]) for c in ("vector", "squares")
            )
        shared.unpersist()
    return lay, vector, squares


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", shortlist: int | None = None) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = adapt(docs.sparkSession)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        held_out(key).alias("held_out"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    training = rows.filter(~F.col("held_out"))
    partial = training.select("text").mapInArrow(_count, "key long, kind int, n long")
    vocabulary = stored(partial.groupBy("key").agg(F.min("kind").alias("kind"), F.sum("n").alias("n")), "vocabulary")
    lexicon, counts, least = lexicon_of(vocabulary) if shortlist is None else lexicon_of(vocabulary, shortlist)
    width = "u2" if len(counts) < 1 << 16 else "u4"

    # Texts are cut into words twice: to be counted, and to be written as tokens.
    shared = spark.sparkContext.broadcast(lexicon)
    turn = F.pmod(F.xxhash64("text", "doc_id"), F.lit(ROUNDS)).cast("int").alias("turn")
    encoded = rows.select("doc_id", "held_out", turn, "text").mapInArrow(_encode(shared, width), ENCODED)
    encoded = stored(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    shared.unpersist()
    lay, vector, squares = train(encoded.filter(~F.col("held_out")).select("turn", "tokens"), lexicon, counts, width)

    model = spark.sparkContext.broadcast((lexicon.end, lay, vector, squares))
    own = encoded.select("row", "tokens").mapInArrow(_score(model, width), "row long, own double")
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select(
        "row", F.col("r.rare").alias("key"), F.col("r.rare_n").alias("times")
    )
    # Only words with a count beyond the lexicon change what the worker has added up.
    uncommon = vocabulary.filter((F.col("kind") >= 0) & (F.col("n") < least)).select("key", "n")
    more = (
        rare.join(uncommon, "key")
        .groupBy("row")
        .agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain"))
    )
    facts = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "beside")
    return facts.join(own, "row").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        (F.col("own") + F.col("beside") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
