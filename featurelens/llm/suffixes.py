"""Removal of repeated byte strings by column-wise construction of suffix transforms.

Texts are UTF-8 bytes (a null text is empty). Every byte covered by a string of ``LENGTH``
bytes that starts anywhere else as well, in the same document too, is removed; strings are
judged on the input.

1. Each window of ``LENGTH`` bytes elects its least ``ANCHOR``-byte string, so equal windows
   elect equal anchors at the same place in them. Anchors found at one place only are done.
2. Around each other anchor a piece is cut that holds every window electing it. Pieces of
   one anchor are aligned at it and form a small collection; equal pieces are one member.
   An anchor with very many places is cut into ranges of window starts, keyed by the bytes
   all windows of a range share, so its members spread over many collections. A collection
   that is still too large for a task is decided by counts of its single windows.
3. A collection is built column by column from the right. Each round puts one symbol in
   front of every member: a stable sort by that symbol turns the order of the suffixes so
   far into that of the longer suffixes, which is the collection's Burrows-Wheeler step, and
   neighbours' common prefixes grow by one over the least value between their old places.
   Columns come and go in sequence; only the order and the prefixes stay.
4. Windows whose suffix shares ``LENGTH`` bytes with a neighbour are repeated.

Anchors only decide what meets where; equality is decided by bytes, in split collections by
128-bit digests of whole windows. Repeated rows
remove each other, texts shorter than ``LENGTH`` stay whole, null ids are kept, an empty
table gives no rows and columns beside id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.llm import words
from featurelens.session import adapt, stored

LENGTH = 200
ANCHOR = 64
#: Places from which an anchor's windows are dealt to ranges of window starts.
MANY = 1 << 15
RANGES = 8
#: Members whose columns are held at once; collections are kept together.
MEMBERS = 1 << 15
#: Members from which a collection is split into single window starts.
SPLIT = 1 << 16
#: Pieces whose bytes a task remembers having told.
SEEN = 1 << 18
#: Bytes of text whose anchors are elected at once.
ANCHOR_BLOCK = 1 << 20
PAD = 0xFF  # not a byte of UTF-8, equal to nothing


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of every ``width`` neighbours, the leftmost of equal ones."""
    n, size = len(values) - width + 1, 1
    at = np.arange(len(values), dtype=np.int32)
    least = values
    while 2 * size <= width:
        at = np.where(least[size:] < least[:-size], at[size:], at[:-size])
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    ahead = slice(width - size, width - size + n)
    return np.where(least[ahead] < least[:n], at[ahead], at[:n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, width: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the anchors of all documents in ``data``."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = words.prefix_keys(data)
    keys = words.mix((sums[width:] - sums[:-width]) * words.powers(words.BASE_INVERSE, len(data) - width + 1))
    elected = _leftmost_least(keys, length - width + 1)
    # Windows that begin in a document and end in it.
    step = np.zeros(len(elected) + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    step[offsets[long]] += 1
    step[np.minimum(offsets[long + 1] - length + 1, len(elected))] -= 1
    chosen = np.zeros(len(keys), bool)
    chosen[elected[np.cumsum(step[:-1]) > 0]] = True
    places = np.flatnonzero(chosen)
    return places, keys[places]


def common_starts(members: np.ndarray, collection: np.ndarray, starts: int, length: int = LENGTH) -> np.ndarray:
    """Which windows of each member are found in another member of its collection.

    ``members`` is one row of bytes each, ``collection`` ascending; windows begin in the
    first ``starts`` columns.
    """
    count, width = members.shape
    found = np.zeros((count, starts), bool)
    order = np.arange(count)
    group = np.unique(collection, return_inverse=True)[1].astype(np.uint16)
    # prefix[i]: bytes that suffix i shares with the one before it, in the current order.
    prefix = np.zeros(count + 1, np.int16)
    for column in range(width - 1, -1, -1):
        symbol = members[order, column]
        by_symbol = np.argsort(symbol, kind="stable")
        step = by_symbol[np.argsort(group[order[by_symbol]], kind="stable")]
        symbols, turned = symbol[step], order[step]
        groups = group[turned]
        same = np.flatnonzero((symbols[1:] == symbols[:-1]) & (groups[1:] == groups[:-1]) & (symbols[1:] != PAD))
        grown = np.zeros(count + 1, np.int16)
        if len(same):
            bounds = np.empty(2 * len(same), np.int64)
            bounds[0::2] = step[same] + 1
            bounds[1::2] = step[same + 1] + 1
            grown[same + 1] = np.minimum.reduceat(prefix, bounds)[0::2] + 1
        order, prefix = turned, grown
        if column < starts:
            shared = prefix[:count] >= length
            shared[:-1] |= prefix[1:count] >= length
            found[order, column] = shared
    return found


def runs(found: np.ndarray) -> list[list[int]]:
    """First and last column of each run of true values, per row, flat."""
    edge = np.zeros((found.shape[0], found.shape[1] + 2), np.int8)
    edge[:, 1:-1] = found
    change = np.diff(edge, axis=1)
    out: list[list[int]] = [[] for _ in range(len(found))]
    begin_row, begin = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    for row, a, b in zip(begin_row.tolist(), begin.tolist(), (end - 1).tolist(), strict=True):
        out[row] += (a, b)
    return out


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in words.blocks(batch, limit=ANCHOR_BLOCK):
            data, offsets = words.raw(block.column(1))
            places, keys = anchors(data, offsets)
            cut = np.searchsorted(places, offsets).astype(np.int32)
            doc = np.searchsorted(offsets, places, side="right") - 1
            full = pa.array(np.diff(cut) > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(keys.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array((places - offsets[doc]).astype(np.int32))),
                ],
                names=["node", "keys", "at"],
            ).filter(full)


def _ranges(many: bool) -> list[tuple[int, int]]:
    starts = LENGTH - ANCHOR + 1
    if not many:
        return [(0, starts)]
    cuts = [starts * i // RANGES for i in range(RANGES + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


PIECES = "collection long, starts int, node binary, at int, digest binary, piece binary, again boolean"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces around anchors: collection, window starts, place of the first column, bytes.

    A task tells the bytes of a piece once; ``again`` marks its second place, and further
    ones are places only.
    """
    reach = LENGTH - ANCHOR
    seen: dict[bytes, bool] = {}
    for batch in batches:
        for block in words.blocks(batch):
            node, text, at = block.column(0).to_pylist(), block.column(1), block.column(2).to_pylist()
            data, offsets = words.raw(text)
            out: list[list] = [[] for _ in range(7)]
            for row, spots in enumerate(at):
                body = bytes([PAD]) * reach + data[offsets[row] : offsets[row + 1]].tobytes() + bytes([PAD]) * LENGTH
                for spot in spots:
                    place, key = spot["at"], spot["key"]
                    # Column c of the piece is byte place - reach + c; body is shifted by reach.
                    for low, high in _ranges(spot["many"]):
                        piece = body[place + low : place + high - 1 + LENGTH]
                        if spot["many"]:
                            core = body[place + high - 1 : place + low + LENGTH]
                            own = hashlib.blake2b(core, digest_size=8, salt=bytes([low])).digest()
                            group = int.from_bytes(own, "little", signed=True)
                        else:
                            group = key
                        digest = hashlib.md5(piece).digest()
                        name = digest + bytes([low, spot["many"]])
                        again = seen.get(name)
                        seen[name] = again is None
                        told = (group, high - low, node[row], place - reach + low, digest, piece if again is None else None, bool(again))
                        for column, value in zip(out, told, strict=True):
                            column.append(value)
                if len(out[0]) >= 4096:
                    yield _pieces(out)
                    out = [[] for _ in range(7)]
            yield _pieces(out)
        if len(seen) > SEEN:
            seen = {}


def _pieces(out: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.bool_())
    names = ["collection", "starts", "node", "at", "digest", "piece", "again"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)


FOUND = "collection long, starts int, digest binary, runs array<int>"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of sorted members (collection, starts, digest, piece)."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= MEMBERS:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("collection").to_numpy()
            # The last collection may go on in the next batch.
            edge = int(np.searchsorted(keys, keys[-1], side="left")) if (np.diff(keys) >= 0).all() else 0
            yield from _build_table(_distinct(table.slice(0, edge)))
            held, count = table.slice(edge).to_batches(), table.num_rows - edge
    if held:
        yield from _build_table(_distinct(pa.Table.from_batches(held).combine_chunks()))


def _distinct(table: pa.Table) -> pa.Table:
    """One row per member, ``several`` where it was told more than once; bytes come first."""
    if not table.num_rows:
        return table.append_column("several", pa.array([], pa.bool_()))
    keys, starts = (table.column(c).to_numpy() for c in ("collection", "starts"))
    digest = np.frombuffer(words.raw(_one(table.column("digest")))[0].tobytes(), "V16")
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1]) | (digest[1:] != digest[:-1])
    first = np.flatnonzero(new)
    several = np.diff(np.append(first, len(keys))) > 1
    return table.take(pa.array(first)).append_column("several", pa.array(several))


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if not isinstance(whole, pa.ChunkedArray) else whole.chunk(0)


def _build_table(table: pa.Table) -> Iterator[pa.RecordBatch]:
    starts = table.column("starts").to_numpy()
    for width in np.unique(starts).tolist():
        chosen = np.flatnonzero(starts == width)
        keys = table.column("collection").to_numpy()[chosen]
        # Whole collections, at most 2**16 members each time unless one is larger.
        begin = 0
        while begin < len(chosen):
            end = min(begin + (1 << 16) - 1, len(chosen))
            if end < len(chosen):
                back = int(np.searchsorted(keys, keys[end], side="left"))
                end = back if back > begin else int(np.searchsorted(keys, keys[end], side="right"))
            part = table.take(pa.array(chosen[begin:end]))
            yield _repeated(part, int(width))
            begin = end


def _repeated(part: pa.Table, width: int) -> pa.RecordBatch:
    pieces = part.column("piece").combine_chunks()
    pieces = pieces.chunk(0) if isinstance(pieces, pa.ChunkedArray) else pieces
    data, _ = words.raw(pieces)
    members = data.reshape(len(pieces), width - 1 + LENGTH)
    keys = part.column("collection").to_numpy()
    alone = np.ones(len(keys), bool)
    alone[1:] &= keys[1:] != keys[:-1]
    alone[:-1] &= keys[:-1] != keys[1:]
    found = np.zeros((len(keys), width), bool)
    if not alone.all():
        found[~alone] = common_starts(members[~alone], keys[~alone], width)
    several = part.column("several").to_numpy(zero_copy_only=False).astype(bool)
    if several.any():
        # A piece at several places repeats each of its whole windows.
        padded = np.concatenate((np.zeros((int(several.sum()), 1), np.int32), np.cumsum(members[several] == PAD, axis=1)), axis=1)
        found[several] = padded[:, LENGTH : LENGTH + width] == padded[:, :width]
    any_found = found.any(axis=1)
    kept = pa.array(any_found)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys[any_found]),
            pa.array(np.full(int(any_found.sum()), width, np.int32)),
            part.column("digest").combine_chunks().filter(kept),
            pa.array(runs(found[any_found]), pa.list_(pa.int32())),
        ],
        names=["collection", "starts", "digest", "runs"],
    )


WINDOWS = "collection long, starts int, digest binary, several boolean, c int, w binary"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every whole window of each member, by its start and digest."""
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            rows: list[list] = [[] for _ in range(6)]
            for row in batch.slice(first, 512).to_pylist():
                piece = row["piece"]
                for c in range(row["starts"]):
                    window = piece[c : c + LENGTH]
                    if PAD not in window:
                        fixed = (row["collection"], row["starts"], row["digest"], row["several"])
                        for column, value in zip(rows, (*fixed, c, hashlib.md5(window).digest()), strict=True):
                            column.append(value)
            types = (pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.int32(), pa.binary())
            names = [f.split()[0] for f in WINDOWS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)


def _split(members: DataFrame) -> DataFrame:
    """Repeated windows of collections with too many members for one task.

    Single window starts are the narrowest ranges: a member's window is repeated if another
    member has it at the same start, which counts per window decide, added up by each task
    before they move.
    """
    distinct = members.groupBy("collection", "starts", "digest").agg(
        F.first("piece", ignorenulls=True).alias("piece"), (F.count(F.lit(1)) > 1).alias("several")
    )
    windows = stored(distinct.select("collection", "starts", "digest", "several", "piece").mapInArrow(_windows, WINDOWS), "windows")
    twice = windows.groupBy("collection", "c", "w").agg(F.count(F.lit(1)).alias("n"), F.max("several").alias("any"))
    twice = twice.filter("n > 1 or any").select("collection", "c", "w")
    found = windows.join(twice, ["collection", "c", "w"]).groupBy("collection", "starts", "digest")
    at = F.flatten(F.transform(F.sort_array(F.collect_set("c")), lambda c: F.array(c, c)))
    return found.agg(at.alias("runs"))


def merged(spans: list) -> list[tuple[int, int]]:
    """Sorted, disjoint unions of (begin, end) spans; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _apply(as_text: bool):
    return lambda batches: _applied(batches, as_text)


def _applied(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in words.blocks(batch):
            node, spans = block.column(0), block.column(2).to_pylist()
            data, offsets = words.raw(block.column(1))
            kept, first, last = [], [], []
            for row, own in enumerate(spans):
                body = data[offsets[row] : offsets[row + 1]].tobytes()
                joined = merged([(s["begin"], s["end"]) for s in own])
                edges = [0, *(x for span in joined for x in span), len(body)]
                kept.append(b"".join(body[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)))
                first.append([a for a, _ in joined])
                last.append([b for _, b in joined])
            yield pa.RecordBatch.from_arrays(
                [
                    node,
                    # Bytes of characters that were cut in two are no text.
                    pa.array([b.decode("utf-8", "ignore") for b in kept] if as_text else kept, pa.string() if as_text else pa.binary()),
                    pa.array(first, pa.list_(pa.int32())),
                    pa.array(last, pa.list_(pa.int32())),
                ],
                names=["node", "kept", "begins", "ends"],
            )


def remainders(rows: DataFrame, as_text: bool = False) -> DataFrame:
    """Of ``node, text`` rows: what is left of every text that loses bytes.

    ``node, kept, begins, ends`` with the remaining bytes and the removed spans, one row per
    text that shares a string with another place; texts that occur in several rows are not
    judged against their own copies here. ``as_text`` gives ``kept`` as a string.
    """
    long = rows.filter(F.octet_length("text") >= LENGTH).withColumn("nid", F.xxhash64("node"))
    drawn = long.select("node", "text").mapInArrow(_places, "node binary, keys array<long>, at array<int>")
    # Copies are one text from here on, so that no anchor gathers them.
    places = stored(drawn.groupBy("node").agg(F.first("keys").alias("keys"), F.first("at").alias("at")), "anchors")
    spots = places.select(F.xxhash64("node").alias("nid"), F.explode(F.arrays_zip("keys", "at")).alias("s")).select(
        "nid", F.col("s.keys").alias("key"), F.col("s.at").alias("at")
    )
    # Each text has one row, so a key's rows are its places.
    repeated = (
        spots.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("key", (F.col("n") > MANY).alias("many"))
    )
    of_text = (
        spots.join(repeated, "key")
        .groupBy("nid")
        .agg(F.collect_list(F.struct("at", "key", "many")).alias("at"))
    )
    texts = long.join(of_text, "nid").groupBy("node").agg(F.first("text").alias("text"), F.first("at").alias("at"))
    texts = stored(texts, "repeating")
    occurrences = stored(texts.select("node", "text", "at").mapInArrow(_cut, PIECES), "pieces")
    told = occurrences.filter("piece is not null or again").select("collection", "starts", "digest", "piece")
    # Rows of a collection: its members, at most twice for each task.
    large = told.filter("piece is not null").groupBy("collection").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT)
    large = stored(large.select("collection"), "large")
    members = (
        told.join(large, "collection", "left_anti")
        .repartition("collection")
        .sortWithinPartitions("collection", "starts", "digest", F.col("piece").isNull())
    )
    found = stored(members.mapInArrow(_build, FOUND).unionByName(_split(told.join(large, "collection", "left_semi"))), "found")
    spans = (
        occurrences.select("collection", "starts", "digest", "node", "at")
        .join(found, ["collection", "starts", "digest"])
        .select("node", "at", F.explode(F.expr("transform(sequence(0, size(runs) div 2 - 1), i -> struct(runs[2*i] as a, runs[2*i+1] as b))")).alias("r"))
        .select("node", (F.col("at") + F.col("r.a")).alias("begin"), (F.col("at") + F.col("r.b") + LENGTH).alias("end"))
        .distinct()
        .groupBy("node")
        .agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    )
    return texts.select("node", "text").join(spans, "node").mapInArrow(
        _apply(as_text), f"node binary, kept {'string' if as_text else 'binary'}, begins array<int>, ends array<int>"
    )


def _noded(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn("__body", body).withColumn("__node", F.unhex(F.md5(F.col("__body").cast("binary"))))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes)."""
    narrow, left = _parts(docs, key, text)
    return narrow.join(left, "node", "left").select(
        "doc_id",
        "n_bytes",
        *_counts(),
        F.when(_all_gone(), F.lit(b"")).otherwise(F.coalesce("kept", F.col("text").cast("binary"))).alias("kept"),
    )


def strip(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with the remaining text of every row; ``length`` is set to its characters.

    A text of several rows is a repeat of itself and is emptied if it is long enough.
    """
    adapt(docs.sparkSession)
    rows = _noded(docs, text)
    narrow = rows.select(F.col("__node").alias("node"), F.col("__body").alias("text"))
    copies = narrow.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("text")).alias("size"))
    left = copies.filter("copies > 1").join(remainders(narrow, as_text=True), "node", "full")
    gone = (F.col("copies") > 1) & (F.col("size") >= LENGTH)
    left = left.select(F.col("node").alias("__left"), F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("__kept"))
    left = left.filter(F.col("__kept").isNotNull())
    joined = rows.join(left, F.col("__node") == F.col("__left"), "left")
    new = F.coalesce("__kept", text)
    out = {text: new} | ({length: F.length(new).cast(docs.schema[length].dataType)} if length else {})
    return joined.select(*(out[c].alias(c) if c in out else F.col(c) for c in docs.columns))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``remove`` with the SHA-256 of the remaining bytes, so that no text moves."""
    narrow, left = _parts(docs, key, text)
    left = left.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    narrow = narrow.withColumn("own_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")
    return narrow.join(left, "node", "left").select(
        "doc_id",
        "n_bytes",
        *_counts(),
        F.when(_all_gone(), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256"),
    )


def _all_gone():
    return (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)


def _counts():
    removed = F.aggregate(F.zip_with("begins", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return (
        F.when(_all_gone(), F.col("n_bytes")).otherwise(F.coalesce(removed, F.lit(0))).cast("long").alias("n_removed"),
        F.when(_all_gone(), F.lit(1)).otherwise(F.coalesce(F.size("begins"), F.lit(0))).cast("long").alias("n_spans"),
    )


def _parts(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    adapt(docs.sparkSession)
    rows = _noded(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")), "t")
    rows = rows.select("doc_id", F.col("__node").alias("node"), F.col("__body").alias("text"))
    left = remainders(rows.select("node", "text"))
    copies = rows.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    left = stored(copies.join(left, "node", "left").filter("copies > 1 or kept is not null"), "left")
    return rows.withColumn("n_bytes", F.octet_length("text").cast("long")), left
