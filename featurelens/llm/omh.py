"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles (of all its words if it has fewer). Each
shingle is labelled with its occurrence number, and each of ``SKETCHES`` hash functions
keeps the ``KEPT`` least labelled shingles in text order; texts that agree in one such
sequence are candidates. Similar texts may agree in none of them, so an exact pass follows:
labelled shingles stand in one global order, rare ones first, and texts that are similar
enough share a known number of entries among the first of each (prefix filter), so the
pairs that do are candidates too unless their texts are joined already. The order is drawn
from a share of the texts; it decides how many candidates there are, not which links are found.
A candidate pair is linked when an order-keeping alignment of the
two shingle sequences matches ``L`` of ``a`` and ``b`` shingles with
``L / (a + b - L) >= SIMILARITY``. An alignment that good leaves at most ``a + b - 2 L``
shingles unmatched, so only matches inside that band of diagonals count.

Links join texts into groups (connected components). Within a candidate bucket every text
is first compared with one centre, the text that shares the most buckets with others. What
then still lies in different groups is compared inside tasks, in blocks of bounded size:
texts of a bucket's largest group meet the others but not each other, so they move once per
block of those. Shared shingles are counted for one text against the block at a time, and pairs that have
enough of them are aligned, unless a link found meanwhile has joined their groups. No
bucket is capped, and pairs are not listed as rows: a task only returns its links.

Equal texts are one node. A null text is empty; texts without words are joined with equal
texts only; repeated rows and ids give repeated rows; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurelens.llm import graph, words
from featurelens.session import adapt, stored

WIDTH = 5
SIMILARITY = 0.8
SKETCHES = 16
KEPT = 3
#: Texts and shingles that a block of a bucket holds at most.
BLOCK_TEXTS = 2048
BLOCK_SHINGLES = 1 << 20
#: Least number of texts whose shingles are counted for the order, one of so many texts of larger
#: tables, and common shingles told to all tasks.
COUNTED_TEXTS = 8192
COUNTED_SHARE = 16
COMMON = 1 << 17
#: Texts of a prefix bucket up to which its pairs are listed; larger ones are compared in blocks.
LISTED_TEXTS = 256
#: A prefix has one further entry per this many shingles, and pairs must share as many more.
SPARE = 20


def _odd(count: int) -> np.ndarray:
    return words.mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(words.BASE)) | np.uint64(1)


def shingles(w: words.Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingle keys of all documents in a row and ``n + 1`` offsets."""
    count = np.diff(w.first)
    n = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(n)))
    keys = np.zeros(int(first[-1]), np.uint64)
    if len(w.key) >= width:
        all_keys = words.shingle_keys(w.key, width)
        long = np.repeat(count >= width, n)
        begin = np.arange(len(keys)) - np.repeat(first[:-1] - w.first[:-1], n)
        keys[long] = all_keys[begin[long]]
    for row in np.flatnonzero((count > 0) & (count < width)):
        keys[first[row]] = words.shingle_keys(w.key[w.first[row] : w.first[row + 1]], int(count[row]))[0]
    return keys, first


def occurrences(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many equal keys of the same document stand before each key."""
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    own = words.mix(keys ^ words.mix(doc + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    ordered = own[order]
    new = np.ones(len(own), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.arange(len(own))
    out = np.empty(len(own), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def sketches(keys: np.ndarray, first: np.ndarray, count: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """One row of ``count`` bucket keys per document; documents must have shingles."""
    labelled = words.mix(keys + occurrences(keys, first).astype(np.uint64) * np.uint64(words.BASE_INVERSE))
    size = np.diff(first)
    heads = first[:-1]
    doc = np.repeat(np.arange(len(size)), size)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.empty((len(size), count), np.uint64)
    for function, odd in enumerate(_odd(count)):
        drawn = labelled * odd
        drawn ^= drawn >> np.uint64(29)
        at = np.full((len(size), kept), np.iinfo(np.int64).max)
        for step in range(kept):
            least = np.minimum.reduceat(drawn, heads)
            hit = np.flatnonzero(drawn == least[doc])
            rows, where = np.unique(doc[hit], return_index=True)
            live = size[rows] > step
            at[rows[live], step] = hit[where][live]
            drawn[hit] = top
        at.sort(axis=1)
        value = np.full(len(size), np.uint64(function + 1), np.uint64)
        for step in range(kept):
            present = at[:, step] < len(labelled)
            part = np.where(present, labelled[np.minimum(at[:, step], len(labelled) - 1)], np.uint64(0))
            value = words.mix(value * np.uint64(words.BASE) + part)
        out[:, function] = value
    return out


def matches(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """Matched shingles of the best alignment in the band that ``need`` matches leave.

    Exact whenever the best alignment reaches ``need``; below it, some lower bound.
    """
    band = len(a) + len(b) - 2 * need
    if band < 0:
        return 0
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    n -= head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1]) if n else ()
    tail = int(differ[0]) if len(differ) else n
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    at_a, at_b = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    a, b = a[at_a], b[at_b]
    found = head + tail
    if found + min(len(a), len(b)) < need or not len(a) or not len(b):
        return found
    if len(a) == len(b) and (a == b).all() and (np.abs(at_a - at_b) <= band).all():
        return found + len(a)
    masks: dict[int, int] = {}
    for i, key in enumerate(a.tolist()):
        masks[key] = masks.get(key, 0) | 1 << i
    places = at_a.tolist()
    row = full = (1 << len(a)) - 1
    for place, key in zip(at_b.tolist(), b.tolist(), strict=True):
        low, high = bisect_left(places, place - band), bisect_right(places, place + band)
        if low < high:
            hit = row & masks[key] & ((1 << high) - (1 << low))
            row = ((row + hit) | (row - hit)) & full
    return found + len(a) - row.bit_count()


def needed(a: int, b: int, similarity: float = SIMILARITY) -> int:
    """Least matches with which sizes ``a`` and ``b`` reach the similarity."""
    return int(np.ceil(similarity / (1 + similarity) * (a + b) - 1e-9))


def _node(text):
    return F.unhex(F.md5(text.cast("binary")))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in words.blocks(batch):
            w = words.table(block.column(1))
            worded = np.diff(w.first) > 0
            if not worded.any():
                continue
            keys, first = shingles(w)
            first = np.unique(first)  # documents without words have no extent
            buckets = sketches(keys, first)
            flat = pa.array(buckets.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0).filter(pa.array(worded)),
                    pa.array(np.diff(first)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(buckets) + 1) * SKETCHES, pa.int32()), flat),
                ],
                names=["node", "n", "buckets"],
            )


def _verify(similarity: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch, "text_a"):
                left = shingles(words.table(block.column(2)))
                right = shingles(words.table(block.column(3)))
                good = np.zeros(block.num_rows, bool)
                for i in range(block.num_rows):
                    a, b = (keys[first[i] : first[i + 1]] for keys, first in (left, right))
                    need = needed(len(a), len(b), similarity)
                    good[i] = need > 0 and matches(a, b, need) >= need
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in block.columns[:2]], names=["a", "b"])

    return verified


def _links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose texts are similar enough, stored."""
    with_texts = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return stored(with_texts.mapInArrow(_verify(similarity), "a binary, b binary"), "links")


def _texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """One stored row ``node, text`` for each of the nodes."""
    found = docs.join(nodes, "node", "left_semi")
    return stored(found.groupBy("node").agg(F.first("text").alias("text")), "texts")


def _labelled(block: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    keys, first = shingles(words.table(block))
    return words.mix(keys + occurrences(keys, first).astype(np.uint64) * np.uint64(words.BASE_INVERSE)), first


def _labels_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in words.blocks(batch):
            yield pa.RecordBatch.from_arrays([pa.array(_labelled(block.column(1))[0].view(np.int64))], names=["key"])


def common_shingles(texts_by_node: DataFrame) -> np.ndarray:
    """Labelled shingles that several of some texts share, from rare to common; at most ``COMMON``."""
    rows = max(1, texts_by_node.count())
    # A fixed number of texts would hold shingles of some hundreds of texts once at most where the table is large.
    counted = max(COUNTED_TEXTS, rows // COUNTED_SHARE)
    some = texts_by_node.filter(F.pmod(F.xxhash64("node"), F.lit(rows)) < counted)
    one_each = some.groupBy("node").agg(F.first("text").alias("text"))
    counts = one_each.mapInArrow(_labels_of, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    top = counts.filter("texts > 1").orderBy(F.desc("texts"), "key").limit(COMMON)
    found = top.toArrow().column("key").to_numpy().astype(np.int64)
    return found[::-1].view(np.uint64).copy()


def prefix_size(n, similarity: float = SIMILARITY):
    """Entries of the global order that a text of ``n`` shingles is looked up by (integers or a column)."""
    if isinstance(n, int):
        return min(n, int(n * (1 - similarity) + 1e-6) + 1 + n // SPARE)
    return F.least(n, F.floor(n * (1 - similarity) + 1e-6) + 1 + F.floor(n / SPARE))


def prefixes(labelled: np.ndarray, first: np.ndarray, common: np.ndarray, similarity: float = SIMILARITY) -> list[np.ndarray]:
    """The first entries of every document in the global order; ``common`` ends it."""
    order = np.argsort(common)
    ordered = common[order]
    entry = labelled >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(ordered, labelled), len(common) - 1)
        entry = np.where(ordered[at] == labelled, np.uint64(1 << 63) + order[at].astype(np.uint64), entry)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        size = prefix_size(b - a, similarity)
        out.append(entry[a:b] if size == b - a else np.partition(entry[a:b], size - 1)[:size])
    return out


def _prefixes(common: np.ndarray, similarity: float):
    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch):
                labelled, first = _labelled(block.column(1))
                own = prefixes(labelled, first, common, similarity)
                sizes = [len(x) for x in own]
                node = block.column(0).take(pa.array(np.repeat(np.arange(len(own)), sizes)))
                n = np.repeat(np.diff(first), sizes).astype(np.int32)
                bucket = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), node, pa.array(n)], names=["bucket", "node", "n"])

    return drawn


def _blocks(texts, all_n):
    return F.greatest(F.ceil(texts / BLOCK_TEXTS), F.ceil(all_n / BLOCK_SHINGLES)).cast("int")


def _one_of_equal(buckets: DataFrame) -> DataFrame:
    """``bucket, blocks`` of the buckets that hold several labels, one of those with the same texts."""
    return (
        buckets.groupBy("bucket")
        .agg(
            F.min("label").alias("low"),
            F.max("label").alias("high"),
            F.count(F.lit(1)).alias("texts"),
            F.sum("n").alias("all_n"),
            *(F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(38, 0)")).alias(f"set{i}") for i in (1, 2)),
        )
        .filter("low <> high")
        .groupBy("texts", "set1", "set2")
        .agg(F.min("bucket").alias("bucket"), F.max("all_n").alias("all_n"))
        .select("bucket", _blocks(F.col("texts"), F.col("all_n")).alias("blocks"))
    )


def _cells(opened: DataFrame) -> DataFrame:
    """``bucket, i, j, own, node, label``: the rows of each bucket in every pair of blocks ``i, j`` they are compared in.

    Blocks below ``rest`` hold the texts outside the bucket's largest label and meet all blocks;
    those of that label follow and only meet the blocks below ``rest``.
    """
    part = F.xxhash64("node")
    one = opened.filter("blocks = 1").select("bucket", *(F.lit(0).alias(c) for c in ("i", "j", "own")), "node", "label")
    many = opened.filter("blocks > 1")
    by_label = many.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("all_n"))
    total = by_label.groupBy("bucket").agg(
        F.max(F.struct("texts", "label", "all_n")).alias("main"), F.sum("texts").alias("texts"), F.sum("all_n").alias("all_n")
    )
    total = total.select(
        "bucket",
        F.col("main.label").alias("main"),
        _blocks(F.col("main.texts"), F.col("main.all_n")).alias("mains"),
        _blocks(F.col("texts") - F.col("main.texts"), F.col("all_n") - F.col("main.all_n")).alias("rest"),
    )
    inside = F.col("label") == F.col("main")
    own = F.when(inside, F.col("rest") + F.pmod(part, F.col("mains"))).otherwise(F.pmod(part, F.col("rest")))
    last = F.when(inside, F.col("rest") - 1).otherwise(F.col("rest") + F.col("mains") - 1)
    dealt = (
        many.join(total, "bucket")
        .select("bucket", "node", "label", own.cast("int").alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")
    )
    return one.unionByName(dealt)


def _compared(labelled: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between the labels of each bucket of ``bucket, node, n, label``, found in blocks and stored."""
    opened = stored(labelled.select("bucket", "node", "n", "label").join(_one_of_equal(labelled), "bucket"), "open")
    keys = (
        texts.join(opened.select("node").distinct(), "node", "left_semi")
        .select("node", "text")
        .mapInArrow(_keys, "node binary, keys binary")
    )
    dealt = (
        _cells(opened)
        .join(keys, "node")
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
        .select("bucket", "i", "j", "own", "node", "label", "keys")
    )
    return stored(dealt.mapInArrow(_compare(similarity), "a binary, b binary"), "links")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` after the links between nodes have joined labels; stored."""
    joined = links.join(labels.withColumnRenamed("label", "la"), F.col("a") == F.col("node"), "left").drop("node")
    joined = joined.join(labels.withColumnRenamed("label", "lb"), F.col("b") == F.col("node"), "left").drop("node")
    joined = joined.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = stored(graph.components(joined, "a", "b"), "merged").select(F.col("node").alias("label"), F.col("label").alias("whole"))
    known = labels.join(merged, "label", "left").select("node", F.coalesce("whole", "label").alias("label"))
    # Nodes that had no label of their own so far.
    new = merged.join(labels, merged["label"] == labels["node"], "left_anti").select(F.col("label").alias("node"), F.col("whole").alias("label"))
    return stored(known.unionByName(new), "groups")


def _with_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def joined_texts(texts_by_node: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``node, whole`` for every text with links, from rows ``node, text``.

    ``whole`` is the least node of the group of near-duplicates; texts left out are alone.
    """
    labels = _joined_by_sketches(texts_by_node, similarity)
    return _joined_by_prefixes(texts_by_node, labels, similarity).withColumnRenamed("label", "whole")


def _joined_by_sketches(texts_by_node: DataFrame, similarity: float) -> DataFrame:
    """``node, label`` of the texts that candidates of the sketches have joined."""
    drawn = texts_by_node.mapInArrow(_sketch, "node binary, n long, buckets array<long>")
    nodes = drawn.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "buckets")))
    entries = stored(nodes.select("node", "n", F.explode("buckets").alias("bucket")), "sketches")
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    members = stored(entries.join(shared, "bucket"), "members")
    met = members.groupBy("node").agg(F.sum("texts").alias("met"))
    known = members.join(met, "node")
    centres = known.groupBy("bucket").agg(F.max(F.struct("met", "node", "n")).alias("centre"))
    least = F.lit(similarity)
    stars = (
        members.join(centres, "bucket")
        .filter(F.col("node") != F.col("centre.node"))
        .filter(F.least("n", "centre.n") >= least * F.greatest("n", "centre.n"))
        .select(F.col("centre.node").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    texts = _texts_of(members.select("node").distinct(), texts_by_node)
    first_links = _links(stars, texts, similarity)
    labels = stored(graph.components(first_links, "a", "b"), "labels")

    # Buckets whose members are not yet one group; two texts have already been compared.
    labelled = stored(_with_labels(members.filter("texts > 2"), labels), "labelled")
    return _merged(labels, _compared(labelled, texts, similarity))


def _joined_by_prefixes(texts_by_node: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """``labels`` after all further links, found by a prefix filter that loses none."""
    drawn = texts_by_node.mapInArrow(
        _prefixes(common_shingles(texts_by_node), similarity), "bucket long, node binary, n int"
    )
    own = Window.partitionBy("bucket")
    met = (
        drawn.repartition("bucket")
        .distinct()
        .withColumn("texts", F.count(F.lit(1)).over(own))
        .filter("texts > 1")
    )
    labelled = _with_labels(stored(met, "prefixes"), labels)
    several = labelled.withColumn("low", F.min("label").over(own)).withColumn("high", F.max("label").over(own))
    open_ = stored(several.filter("low <> high").drop("low", "high"), "open")
    small = open_.filter(F.col("texts") <= LISTED_TEXTS)
    left = small.select("bucket", F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    right = small.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    na, nb = F.col("na"), F.col("nb")
    need = F.ceil((na + nb) * (similarity / (1 + similarity)) - 1e-9)
    shared = F.least(prefix_size(na, similarity) - na, prefix_size(nb, similarity) - nb) + need
    pairs = (
        left.join(right, "bucket")
        .filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")))
        .filter(F.least("na", "nb") >= need)
        .groupBy("a", "b", "na", "nb")
        .agg(F.count(F.lit(1)).alias("met"))
        .filter(F.col("met") >= shared)
        .select("a", "b")
    )
    pairs = stored(pairs, "pairs")
    large = open_.filter(F.col("texts") > LISTED_TEXTS)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()
    texts = _texts_of(nodes, texts_by_node)
    links = _links(pairs, texts, similarity).union(_compared(large.select("bucket", "node", "n", "label"), texts, similarity))
    return _merged(labels, links)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: ``doc_id``, ``class_id`` and ``copy_id``.

    ``class_id`` is the least id of the near-duplicate group, ``copy_id`` the least id of
    the rows with an equal text.
    """
    adapt(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(_node(body).alias("node"), F.col(key).cast("long").alias("doc_id"), body.alias("text"))
    near = joined_texts(rows.select("node", "text"), similarity)
    copies = rows.groupBy("node").agg(F.min("doc_id").alias("copy_id"))
    grouped = copies.join(near, "node", "left").withColumn("whole", F.coalesce("whole", "node"))
    grouped = stored(grouped.select("node", "copy_id", "whole"), "classes")
    ids = grouped.groupBy("whole").agg(F.min("copy_id").alias("class_id"))
    known = grouped.join(ids, "whole").select("node", "copy_id", "class_id")
    return rows.select("node", "doc_id").join(known, "node").select("doc_id", "class_id", "copy_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The row with the least id of every near-duplicate group, with all its columns."""
    adapt(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("__all"), _node(body).alias("__node"), F.col(key).alias("__id"))
    near = joined_texts(docs.select(_node(body).alias("node"), body.alias("text")), similarity)
    near = near.withColumnRenamed("node", "__node")
    narrow = docs.select(_node(body).alias("__node"), F.col(key).alias("__id")).groupBy("__node").agg(F.min("__id").alias("__id"))
    whole = narrow.join(near, "__node", "left").withColumn("whole", F.coalesce("whole", "__node"))
    # Where all ids of a group are null its least text stands for it.
    first = F.when(F.col("__id").isNull(), F.lit(1)).otherwise(F.lit(0))
    kept = whole.groupBy("whole").agg(F.min(F.struct(first.alias("none"), "__id", "__node")).alias("kept"))
    kept = kept.select(F.col("kept.__node").alias("n"), F.col("kept.__id").alias("i"))
    chosen = rows.join(kept, (F.col("__node") == F.col("n")) & F.col("__id").eqNullSafe(F.col("i")), "left_semi")
    # Rows that share id and text are one document.
    hashed = F.xxhash64(*(f"__all.{f.name}" for f in docs.schema if not isinstance(f.dataType, T.MapType)))
    one = chosen.groupBy("__node", "__id").agg(F.min_by("__all", hashed).alias("__all"))
    return one.select("__all.*")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in words.blocks(batch):
            keys, first = shingles(words.table(block.column(1)))
            own = [keys[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(own, pa.binary())], names=["node", "keys"])


def links_between(keys: list[np.ndarray], label: list, side: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join the labels of some texts, by shared shingles and then alignment.

    Only texts of different ``side`` are compared where both sides are present. Texts that
    an earlier link has joined are not compared again.
    """
    count = len(keys)
    size = np.array([len(k) for k in keys])
    first = np.concatenate(([0], np.cumsum(size)))
    flat = np.concatenate(keys)
    labelled = words.mix(flat + occurrences(flat, first).astype(np.uint64) * np.uint64(words.BASE_INVERSE))
    text = np.repeat(np.arange(count), size)
    kinds, which, often = np.unique(labelled, return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    holders, begin = text[order], np.cumsum(often) - often
    names = np.unique(np.array(label, dtype=object), return_inverse=True)[1]
    both = len(np.unique(side)) > 1
    # Texts of the largest label are met by the others and need no turn of their own.
    main = names == np.argmax(np.bincount(names))
    out = []
    for x in np.flatnonzero(~main).tolist():
        far = names != names[x]
        far[x:] &= main[x:]
        if both:
            far &= side != side[x]
        far &= np.minimum(size, size[x]) >= similarity * np.maximum(size, size[x])
        if not far.any():
            continue
        own = which[first[x] : first[x + 1]]
        own = own[often[own] > 1]
        shared = np.bincount(words.spread(holders, begin[own], often[own]), minlength=count)
        need = np.ceil(similarity / (1 + similarity) * (size + size[x]) - 1e-9)
        some = np.flatnonzero(far & (shared >= need))
        for y in some[np.argsort(-shared[some], kind="stable")].tolist():
            if names[y] != names[x] and matches(keys[y], keys[x], int(need[y])) >= need[y]:
                out.append((y, x))
                names[names == names[x]] = names[y]
    return out


def _compare(similarity: float):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            links: list[tuple] = []
            for bucket, i, j, own, node, label, keys in zip(*columns, strict=True):
                if (bucket, i, j) != current:
                    links += _links_of(held, similarity)
                    held, current = [], (bucket, i, j)
                held.append((own, node, label, np.frombuffer(keys, np.uint64)))
            yield _pairs(links)
        yield _pairs(_links_of(held, similarity))

    return compared


def _links_of(held: list[tuple], similarity: float) -> list[tuple]:
    if len(held) < 2:
        return []
    own, node, label, keys = zip(*held, strict=True)
    return [(node[a], node[b]) for a, b in links_between(list(keys), list(label), np.array(own), similarity)]


def _pairs(links: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([link[i] for link in links], pa.binary()) for i in (0, 1)], names=["a", "b"]
    )
