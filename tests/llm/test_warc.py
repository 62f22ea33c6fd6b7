import base64
import gzip
import hashlib
import os

import pytest

from featurelens.llm import warc

PAGES = [
    (1, "http://a/ b%20ü", "<p>é</p>"),
    (2, None, None),
    (3, "http://c", ""),
    (4, "http://d", "same"),
    (9, "http://e", "same"),
    (7, "http://f", "same"),
    (9, "http://e", "same"),
    (None, "http://g", "same"),
    (None, "http://h", "alone"),
    (10, "line\r\nbreak", "x" * 400_000),
    (11, "http://i", "\r\n\r\nWARC/1.1\r\n"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 0, "d") for p in PAGES], "page_id long, url string, html string, offset long, digest string").repartition(3)


def test_round_trip(pages, tmp_path):
    index = warc.write(pages, f"file://{tmp_path}/out").cache()
    got = warc.read(index).collect()
    size = {}
    for r in got:
        body = next((h or "").encode() for i, u, h in PAGES if i == r.page_id and (u is None or r.url == u))
        assert r.payload_bytes == len(body) and base64.b32decode(r.payload_digest) == hashlib.sha1(body).digest()
        assert (r.payload == body) if r.record_type == "response" else r.payload is None
        size.setdefault(body, []).append(r)
    assert len(got) == len(PAGES)
    for rows in size.values():
        top = max((r.page_id for r in rows if r.page_id is not None), default=None)
        assert [r.page_id for r in rows if r.record_type == "response"] == [top]
        assert all(r.refers_to == top for r in rows if r.record_type == "revisit")
    # Every index row gives one whole gzip member of a valid file.
    for r in index.collect():
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")
    for name in os.listdir(f"{tmp_path}/out"):
        if name.endswith(".gz"):
            with gzip.open(f"{tmp_path}/out/{name}") as f:
                assert f.read().count(b"WARC-Type: ") >= 1


def test_smaller_payloads_are_all_responses(pages):
    got = warc.read(warc.write(pages, min_bytes=5), payload=False).collect()
    assert {r.record_type for r in got if r.payload_bytes < 5} == {"response"}
    assert all(r.payload is None for r in got)


def test_a_selection_reads_only_its_ranges(pages, monkeypatch):
    monkeypatch.setattr(warc, "GAP", 64)
    index = warc.write(pages.coalesce(1))
    some = index.filter("page_id in (1, 10, 11)")
    covered = sum(r.last - r.first for r in warc.ranges(some).collect())
    assert covered < index.agg({"length": "sum"}).first()[0]
    assert sorted(r.page_id for r in warc.read(some).collect()) == [1, 10, 11]


def test_empty_tables(pages):
    index = warc.write(pages.limit(0))
    assert index.count() == 0 and warc.read(index).count() == 0


def test_registered_query_matches_brute_force(spark):
    from awkward import SMOKE

    from featurelens.llm import queries

    table = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SMOKE}/pages.parquet").collect()]
    top = {}
    for page, body in table:
        top[body] = max(page, top.get(body, page))
    want = sorted(
        (p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *(("response", None) if top[b] == p else ("revisit", top[b])))
        for p, b in table
    )
    assert sorted(tuple(r) for r in queries.QUERIES["op10_warc_index"](spark, SMOKE).collect()) == want


def test_several_tasks_read_several_files(spark, tmp_path):
    from pyspark.sql import functions as F

    import random

    rng = random.Random(3)
    rows = [(i, f"u{i}", "".join(rng.choices("abcdefgh", k=40_000))) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    index = warc.write(pages, f"file://{tmp_path}/many")
    read = warc.read(index, payload=False)
    tasks = read.select("page_id", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.page_id for r in tasks) == list(range(120)) and len({r.task for r in tasks}) > 1
    assert index.select("file").distinct().count() > 1


def test_one_payload_of_many_pages(spark):
    rows = [(i, f"u{i % 7}", "shared page " * 50) for i in range(600)] + [(700, "u", "shared page " * 50)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    got = warc.read(warc.write(pages)).collect()
    assert len(got) == 603 and [r.page_id for r in got if r.record_type == "response"] == [700]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {700} and sum(r.page_id == 700 for r in got) == 3
