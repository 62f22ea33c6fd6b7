"""The pipeline against brute force, and its queries beside the rest."""

import random
import subprocess
import sys

from awkward import SMOKE
from test_decontam import brute as leaks
from test_omh import brute as groups
from test_quality import brute as quality
from test_suffixes import brute as suffixes

import corpus_pipeline
from featurelens.llm import omh, packing, queries


def expected(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    rows = [r for r in rows if quality(r[1])[-1]]
    rows = [r for r, (_, least) in zip(rows, groups(rows), strict=True) if r[0] == least]
    cut = suffixes([t for _, t in rows])
    rows = [(key, kept.decode("utf-8", "ignore")) for (key, _), (_, _, _, kept) in zip(rows, cut, strict=True)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMOKE}/benchmark.parquet").collect()]
    bad = {key for key, _, _ in leaks(rows, items)}
    return {key: tokenizer.encode(t, add_special_tokens=False).ids + [1] for key, t in rows if key not in bad}


def test_pipeline_matches_brute_force(spark):
    tokenizer = packing.WordTokenizer(queries.tokenizer_path(corpus_pipeline.TOKENIZER)).tokenizer
    want = expected(spark, tokenizer)
    got = {}
    for r in queries.QUERIES["pipeline"](spark, SMOKE).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(got) == set(want)
    for key, parts in got.items():
        assert {n for _, _, n in parts} == {len(want[key])} == {sum(length for _, length, _ in parts)}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMOKE)
        assert out.columns == docs.columns and out.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMOKE).count() == 0


def test_a_line_of_many_documents_sends_none_of_them_whole_to_a_bucket(spark, monkeypatch):
    """The second stage moves no keys for documents that only share a line, and keeps them all."""
    monkeypatch.setattr(omh, "COUNTED_TEXTS", 4)
    monkeypatch.setattr(omh, "LISTED_TEXTS", 20)
    moved, compared = [], omh._compared
    monkeypatch.setattr(omh, "_compared", lambda rows, *more: moved.append(rows.count()) or compared(rows, *more))
    rng = random.Random(4)
    line = " ".join(f"line{i}" for i in range(12))
    rows = [(i, (line if i % 8 == 0 else "") + "".join(f" u{rng.randrange(10**7)}" for _ in range(40))) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, SMOKE)
    assert moved[-1] == 0
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(1600))


def test_the_rest_works_without_the_subpackage(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('featurelens.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert 'position_share' in names and not any(n.startswith('op') or n == 'pipeline' for n in names)\n"
        "assert set(e.oracle_sql()) <= names\n"
    )
    root = corpus_pipeline.__file__.rsplit("/", 1)[0]
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_the_first_query_of_each_operator():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
