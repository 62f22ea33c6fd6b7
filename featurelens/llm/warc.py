"""WARC archives: an index written with the records, and coalesced range reads.

``write`` turns every page into a record of a WARC/1.1 file (one gzip member each) below a
folder all executors share. Of pages with equal payloads of at least ``min_bytes`` the one
with the greatest id is the response, the others are revisits that refer to it and hold
HTTP headers only. With each record goes an index row: file, offset, length, URL, digest.
``read`` takes any selection of index rows, sorts it by place, joins neighbours whose gap is
small into byte ranges, and reads a range with one call.

Files are named anew by each attempt of a task, and the stored index names only those of
the attempts that counted, so lost executors leave unreferenced files at worst. A null
payload is empty; a null URL writes no target; null ids come before all others; of equal
ids with equal payloads one is the response; empty tables give an empty index; other
columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelens.session import adapt, scratch_path, stored
from featurelens.sources.paths import opened, qualified

#: A file is closed once it is this large.
FILE_BYTES = 256 << 20
#: Ranges are cut at multiples of this and where more than GAP unselected bytes lie between.
RANGE_BYTES = 4 << 20
GAP = 64 << 10
#: Bytes of ranges that a reading task gets, on average.
TASK_BYTES = 32 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"

INDEX = (
    "file string, offset long, length long, url string, digest string, record_type string, page_id long, refers_to long"
)
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def _urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if name in ("", "none") else int(name)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record(
    page: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str = DATE
) -> bytes:
    """One WARC record, uncompressed; a revisit has no payload, only its size."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=_URL_SAFE)}")
    if revisit:
        head.append(f"WARC-Refers-To: {_urn(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


#: Printable ASCII stays as it is, but for the percent sign that marks the rest.
_URL_SAFE = "".join(chr(c) for c in range(0x21, 0x7F) if c != 0x25)


def parsed(body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record."""
    head, _, rest = body.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record ends early")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _write(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, file, at = None, None, 0
        try:
            for batch in batches:
                rows: list[tuple] = []
                columns = zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for page, url, payload, size, digest, refers_to in (
                    row[:-1] for row in columns for _ in range(row[-1])
                ):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        system, base = opened(folder)
                        system.create_dir(base, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, file, at = system.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0
                    revisit, name = payload is None, base32(digest)
                    kind = "revisit" if revisit else "response"
                    member = gzip.compress(record(page, url, payload, size, name, refers_to, date), LEVEL, mtime=0)
                    out.write(member)
                    rows.append((file, at, len(member), url, name, kind, page, refers_to if revisit else None))
                    at += len(member)
                if rows:
                    yield _table(rows, INDEX)
        finally:
            if out is not None:
                out.close()

    return write


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(field.split() for field in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), _TYPES[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names)
    )


def write(
    pages: DataFrame,
    folder: str | None = None,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = 0,
    date: str = DATE,
) -> DataFrame:
    """Archive all pages below ``folder`` (default: scratch) and return the stored index."""
    spark = adapt(pages.sparkSession)
    target = qualified(spark, folder or scratch_path(spark, "warc"))
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")
    )
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    # Payloads move once, one per digest and task that has it; all else is decided on narrow rows.
    shared = F.col("size") >= min_bytes
    best = F.max(F.struct("page_id", "url")).alias("top")
    responses = rows.filter(shared).groupBy("digest", "size").agg(best, F.first("payload").alias("payload"))
    alike = rows.filter(shared).groupBy("digest", "size", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    tops = alike.groupBy("digest").agg(best)
    first = F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url"))
    revisits = alike.join(tops, "digest").withColumn("n", F.col("n") - F.when(first, 1).otherwise(0)).filter("n > 0")
    nothing = F.lit(None).cast("binary")
    parts = [
        responses.select("top.page_id", "top.url", "payload", "size", "digest", "top.page_id", F.lit(1).cast("long")),
        revisits.select("page_id", "url", nothing, "size", "digest", "top.page_id", "n"),
        rows.filter(~shared).select("page_id", "url", "payload", "size", "digest", "page_id", F.lit(1).cast("long")),
    ]
    decided = parts[0].union(parts[1]).union(parts[2]).toDF("page_id", "url", "payload", "size", "digest", "refers_to", "copies")
    return stored(decided.mapInArrow(_write(target, date), INDEX), "warc-index")


def ranges(index: DataFrame) -> DataFrame:
    """Byte ranges ``file, first, last, records`` that cover the selected records."""
    order = Window.partitionBy("file", "cell").orderBy("offset")
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(order)
    return (
        index.select("file", "offset", "length", (F.expr(f"offset div {RANGE_BYTES}")).alias("cell"))
        .withColumn("new", F.when(gap > GAP, 1).otherwise(0))
        .withColumn("run", F.sum("new").over(order))
        .groupBy("file", "cell", "run")
        .agg(
            F.min("offset").alias("first"),
            F.max(F.col("offset") + F.col("length")).alias("last"),
            F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"),
        )
        .select("file", "first", "last", "records")
    )


def _read(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first, last, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, path = opened(file)
                with system.open_input_file(path) as source:
                    data = source.read_at(last - first, first)
                out = []
                for place in places:
                    begin = place["offset"] - first
                    headers, http, payload = parsed(gzip.decompress(data[begin : begin + place["length"]]))
                    url = headers.get("WARC-Target-URI")
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
                    kind = headers["WARC-Type"]
                    if kind == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} in {file} is damaged")
                    out.append(
                        (
                            _page(headers["WARC-Record-ID"]),
                            None if url is None else urllib.parse.unquote(url),
                            kind,
                            _page(headers.get("WARC-Refers-To")),
                            size,
                            digest,
                            payload if with_payload and kind == "response" else None,
                        )
                    )
                yield _table(out, RECORDS)

    return read


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """The selected records, from coalesced ranges; revisits have no payload of their own."""
    spark = adapt(index.sparkSession)
    # Ranges are narrow rows that stand for many bytes: their number of tasks follows those bytes.
    size = index.agg(F.sum("length").alias("bytes")).first()["bytes"] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    spread = ranges(index).repartition(tasks, "file", "first")
    return spread.mapInArrow(_read(payload), RECORDS)
