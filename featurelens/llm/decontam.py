"""Benchmark decontamination: BM25 retrieval of test items with block-max WAND.

Test items are indexed as an inverted file: per term the items that hold it with their BM25
share of the item's own full score, the greatest share per term, and the greatest share
per term and block of items. Every training passage (``PASSAGE`` words, a new one each half
passage) is a query of its distinct words; all items that reach ``THRESHOLD`` of their own
score are retrieved. An item of more words than surely fit one passage is indexed whole
and in overlapping pieces of ``PIECE`` words, each scored against its own full score, and is
retrieved when the whole or any piece is. A passage whose terms' greatest shares cannot add up to the threshold
is passed over, as is every block of items whose greatest shares cannot; postings are only
read in the blocks that are left. All passages of a batch take each of these steps together,
and since the threshold is fixed the result is that of scoring every item.

A retrieved pair of document and item is a leak when the document holds at least
``OVERLAP`` of the five-word strings of the item's question and of its answer. Without an
answer column the answer is the item's last sentence (the whole item if it has one).

Words are runs of bytes other than white space and ASCII punctuation, A-Z folded. The index
is cut into parts of about equal numbers of entries by item, each sent to the workers in a pass over the
documents, so its size only adds passes. Null or empty texts and items without words match
nothing, repeated rows and items give repeated pairs, null ids are carried, empty tables
give no rows and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.llm import words
from featurelens.session import adapt, stored

PASSAGE = 96
#: Words of a piece of a long item; wherever it stands in a text, some passage holds all of it.
PIECE = PASSAGE // 2
THRESHOLD = 0.6
OVERLAP = 0.6
WIDTH = 5
K1, B = 1.2, 0.75
#: Entries (items and pieces) of an index part, and of a block inside it.
PART_ITEMS = 4096
BLOCK = 16

_FOLD = words.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def folded(column: pa.Array) -> words.Words:
    data, offsets = words.raw(column)
    return words.of_bytes(_FOLD[data], offsets)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item given as one text."""
    body = text.strip()
    cut = max(body.rfind(mark, 0, len(body) - 1) for mark in (". ", ".\n", "? ", "?\n", "! ", "!\n", "\n"))
    if cut < 0 or not any(c.isalnum() for c in body[cut + 1 :]) or not any(c.isalnum() for c in body[:cut]):
        return body, body
    return body[: cut + 1], body[cut + 1 :]


def _grams(w: words.Words, row: int) -> np.ndarray:
    """Distinct five-word strings of a text, or its only string if it is shorter."""
    keys = w.key[w.first[row] : w.first[row + 1]]
    return np.unique(words.shingle_keys(keys, min(WIDTH, len(keys)))) if len(keys) else np.zeros(0, np.uint64)


def entries(size: int, piece: int = PIECE) -> list[tuple[int, int]]:
    """Word spans that an item is indexed by: the whole, then the pieces of a long one."""
    if size <= piece:
        return [(0, size)]
    begins = [*range(0, size - piece, piece // 2), size - piece]
    return [(0, size), *((a, a + piece) for a in begins)]


def _read_items(has_answer: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            questions = [t or "" for t in batch.column(1).to_pylist()]
            if has_answer:
                pairs = [(q, a or q) for q, a in zip(questions, batch.column(2).to_pylist(), strict=True)]
            else:
                pairs = [split_item(q) for q in questions]
            whole = folded(pa.array([f"{q}\n{a}" if has_answer and q != a else q for q, a in zip(questions, (a for _, a in pairs), strict=True)]))
            parts = [folded(pa.array([p[i] for p in pairs], pa.string())) for i in (0, 1)]
            out: list[list] = [[] for _ in range(9)]
            for row, number in enumerate(batch.column(0).to_pylist()):
                own = whole.key[whole.first[row] : whole.first[row + 1]]
                if not len(own):
                    continue
                spans = entries(len(own))
                counted = [np.unique(own[a:b], return_counts=True) for a, b in spans]
                sizes_of = [len(keys) for keys, _ in counted]
                piece, size = (np.repeat(x, sizes_of) for x in (np.arange(len(spans)), [b - a for a, b in spans]))
                keys, tf = (np.concatenate(x) for x in zip(*counted, strict=True))
                grams = [_grams(p, row) for p in parts]
                sizes = [int(min(WIDTH, p.first[row + 1] - p.first[row])) for p in parts]
                for column, value in zip(
                    out,
                    (number, piece, keys.view(np.int64), tf, size, *(g.view(np.int64) for g in grams), *sizes),
                    strict=True,
                ):
                    column.append(value)
            longs, kinds = pa.list_(pa.int64()), ("item_id", "piece", "term", "tf", "size", "question", "answer", "question_width", "answer_width")
            types = (pa.int64(), longs, longs, longs, longs, longs, longs, pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=list(kinds))

    return read


_ITEMS = (
    "item_id long, piece array<long>, term array<long>, tf array<long>, size array<long>, question array<long>, answer array<long>,"
    " question_width long, answer_width long"
)


def item_table(items: DataFrame, key: str = "item_id", text: str = "text", answer: str | None = None) -> DataFrame:
    """Items with the BM25 shares per term of each entry, stored; statistics are of all whole items."""
    columns = [F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("question")]
    if answer:
        columns.append(F.col(answer).cast("string").alias("answer"))
    read = items.select(*columns).mapInArrow(_read_items(answer is not None), _ITEMS)
    read = stored(read.withColumn("row", F.monotonically_increasing_id()), "items")
    size = read.agg(F.count(F.lit(1)).alias("items"), F.avg(F.col("size")[0]).alias("mean"))
    terms = read.select("row", F.explode(F.arrays_zip("piece", "term", "tf", "size")).alias("t")).select("row", "t.*")
    df = terms.filter("piece = 0").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.expr(
        f"ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * size / mean))"
    )
    weighed = terms.join(df, "term").crossJoin(F.broadcast(size)).withColumn("w", weight)  # one-row side
    lists = weighed.groupBy("row", "piece").agg(F.collect_list(F.struct("term", "w")).alias("weights"), F.sum("w").alias("own"))
    lists = lists.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("piece", "own", "weights"))).alias("entries"))
    return stored(read.drop("piece", "term", "tf", "size").join(lists, "row"), "index")


@dataclass
class Index:
    """One part of the inverted file; entries are numbered in it, ``BLOCK`` to a block."""

    items: list
    of: np.ndarray  # per entry: its item, as a place in ``items``
    whole: np.ndarray  # per entry: whether it is its whole item
    terms: np.ndarray  # sorted term keys
    most: np.ndarray  # greatest share per term
    block_most: np.ndarray  # greatest share per block and term
    block_terms: list  # per block: its terms, as ascending numbers
    block_shares: list  # per block: shares by (term, entry of the block)
    grams: list  # (question, width, answer, width) per item


def build(rows: list) -> Index:
    """The index part of some rows of ``item_table``."""
    term, item, share, of, whole = [], [], [], [], []
    for number, row in enumerate(rows):
        for entry in row["entries"]:
            for t in entry["weights"]:
                term.append(t["term"])
                item.append(len(of))
                share.append(t["w"] / entry["own"])
            of.append(number)
            whole.append(entry["piece"] == 0)
    item, share = np.array(item, np.int64), np.array(share)
    terms, term = np.unique(np.array(term, np.int64).view(np.uint64), return_inverse=True)
    block_most = np.zeros((-(-len(of) // BLOCK), len(terms)))
    np.maximum.at(block_most, (item // BLOCK, term), share)
    block_terms, block_shares = [], []
    for block in range(len(block_most)):
        own = item // BLOCK == block
        here = np.unique(term[own])
        shares = np.zeros((len(here), BLOCK))
        shares[np.searchsorted(here, term[own]), item[own] % BLOCK] = share[own]
        block_terms.append(here)
        block_shares.append(shares)
    grams = [
        tuple(
            np.array(row[c], np.int64).view(np.uint64) if i % 2 == 0 else row[c]
            for i, c in enumerate(("question", "question_width", "answer", "answer_width"))
        )
        for row in rows
    ]
    most = block_most.max(axis=0, initial=0.0)
    return Index([row["item_id"] for row in rows], np.array(of, np.int64), np.array(whole, bool), terms, most, block_most, block_terms, block_shares, grams)


def retrieve(index: Index, window: np.ndarray, term: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(window, entry, score) of all entries that reach the threshold.

    ``window`` ascends and each window has distinct ``term`` numbers.
    """
    found = []
    slack = threshold - 1e-9
    reach = np.bincount(window, weights=index.most[term]) >= slack
    kept = reach[window]
    names, window = np.unique(window[kept], return_inverse=True)
    term = term[kept]
    for block, most in enumerate(index.block_most):
        if not len(names):
            break
        live = np.bincount(window, weights=most[term], minlength=len(names)) >= slack
        if not live.any():
            continue
        some = np.flatnonzero(live[window])
        here = index.block_terms[block]
        at = np.minimum(np.searchsorted(here, term[some]), len(here) - 1)
        posted = here[at] == term[some]
        some, at = some[posted], at[posted]
        heads = np.flatnonzero(np.concatenate(([True], window[some][1:] != window[some][:-1])))
        scores = np.add.reduceat(index.block_shares[block][at], heads, axis=0)
        for row, item in zip(*(x.tolist() for x in np.nonzero(scores >= slack)), strict=True):
            found.append((int(names[window[some[heads[row]]]]), block * BLOCK + item, float(scores[row, item])))
    return found


def candidates(index: Index, w: words.Words, passage: int = PASSAGE, threshold: float = THRESHOLD) -> dict[tuple[int, int], float]:
    """Best score of each (document, item) over the document's passages.

    It is the whole item's where that is retrieved, otherwise that of its best piece.
    """
    if not len(w.key) or not len(index.terms):
        return {}
    stride = passage // 2
    at = np.minimum(np.searchsorted(index.terms, w.key), len(index.terms) - 1)
    token = np.flatnonzero(index.terms[at] == w.key)
    if not len(token):
        return {}
    term = at[token]
    doc = np.searchsorted(w.first, token, side="right") - 1
    place = token - w.first[doc]
    # The place of the same term before, so that a passage counts each term once.
    order = np.lexsort((token, term, doc))
    before = np.full(len(token), -1)
    same = (term[order][1:] == term[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    before[order[1:][same]] = place[order[:-1][same]]
    base = np.concatenate(([0], np.cumsum(-(-np.diff(w.first) // stride))))
    hit_window, hit_term = [], []
    for back in (0, 1):
        number = place // stride - back
        good = (number >= 0) & (before < number * stride)
        hit_window.append(base[doc[good]] + number[good])
        hit_term.append(term[good])
    window, term = np.concatenate(hit_window), np.concatenate(hit_term)
    order = np.argsort(window, kind="stable")
    best: dict[tuple[int, int], tuple[bool, float]] = {}
    for name, entry, score in retrieve(index, window[order], term[order], threshold):
        pair = int(np.searchsorted(base, name, side="right")) - 1, int(index.of[entry])
        best[pair] = max((bool(index.whole[entry]), score), best.get(pair, (False, 0.0)))
    return {pair: score for pair, (_, score) in best.items()}


def overlap(keys: np.ndarray, grams: np.ndarray, width: int) -> float:
    """Share of an item's strings that the document's words hold."""
    return float(np.isin(grams, words.shingle_keys(keys, width)).mean()) if len(grams) else 0.0


def found_leaks(index: Index, w: words.Words) -> Iterator[tuple[int, int, tuple[float, float, float]]]:
    """Retrieved and verified (document, item, (score, question and answer overlap))."""
    for (row, item), score in candidates(index, w).items():
        keys = w.key[w.first[row] : w.first[row + 1]]
        question, question_width, answer, answer_width = index.grams[item]
        shares = overlap(keys, question, question_width), overlap(keys, answer, answer_width)
        if min(shares) >= OVERLAP:
            yield row, item, (score, *shares)


def _leaks_of(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in words.blocks(batch):
            w = folded(block.column(1))
            ids = block.column(0)
            out: list[list] = [[] for _ in range(5)]
            for row, item, measures in found_leaks(index, w):
                for column, value in zip(out, (ids[row].as_py(), index.items[item], *measures), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=LEAK_NAMES)


LEAK_NAMES = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    answer: str | None = None,
    part_items: int = PART_ITEMS,
) -> DataFrame:
    """Verified pairs ``doc_id, item_id, score, question_overlap, answer_overlap``."""
    adapt(docs.sparkSession)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = None
    for shared in index_parts(items, item_key, item_text, answer, part_items):
        some = narrow.mapInArrow(lambda batches, shared=shared: _leaks_of(shared.value, batches), LEAKS)
        found = some if found is None else found.unionByName(some)
    return found


def index_parts(items: DataFrame, key: str, text: str, answer: str | None, part_items: int) -> Iterator:
    """Broadcast index parts of about ``part_items`` entries, made one at a time."""
    index = item_table(items, key, text, answer)
    parts = max(1, -(-(index.agg(F.sum(F.size("entries"))).first()[0] or 0) // part_items))
    numbered = index.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    for part in range(parts):
        rows = numbered.filter(F.col("part") == part).orderBy("row").collect()
        yield items.sparkSession.sparkContext.broadcast(build(rows))


def clean(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    answer: str | None = None,
    part_items: int = PART_ITEMS,
) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns."""
    adapt(docs.sparkSession)
    for shared in index_parts(items, item_key, item_text, answer, part_items):
        docs = words.filtered(docs, text, lambda texts, shared=shared: ~_leaky(shared.value, texts))
    return docs


def _leaky(index: Index, texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), bool)
    for row, _, _ in found_leaks(index, folded(texts)):
        out[row] = True
    return out
