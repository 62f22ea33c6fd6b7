import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from awkward import SMOKE, docs, nothing, texts  # noqa: F401
from featurelens.llm import identify


def grams(text):
    """Buckets of the runs of one, two and three bytes, one by one."""
    kinds = identify._CLASS[np.frombuffer(text.lower().encode(), np.uint8)].tolist()
    out = Counter()
    for i in range(len(kinds)):
        for order in (1, 2, 3):
            run = kinds[i : i + order]
            if len(run) < order or not (run[0] or run[-1]) or (order == 3 and not run[1]):
                continue
            key = run[0] + 1
            for c in run[1:]:
                key = key * 157 + c + 1
            mixed = (key * 0x9E3779B1 + order * 0x85EBCA77) & 0xFFFFFFFF
            out[((mixed >> 15) ^ mixed) % identify.FEATURES] += 1
    row = np.zeros(identify.FEATURES)
    for place, count in out.items():
        row[place] = np.sqrt(count)
    return row / (np.linalg.norm(row) or 1)


@pytest.mark.parametrize("span", [7, 64, 1 << 20])
def test_features_match_one_by_one(texts, monkeypatch, span):  # noqa: F811
    monkeypatch.setattr(identify, "SPAN", span)
    some = [t or "" for t in texts if len(t or "") < 3000][-14:]
    got = identify.features(pa.array(some))
    assert np.allclose(got, [grams(t) for t in some], atol=1e-6)


def test_letters():
    assert identify.lettered(pa.array(["a", "1 2", None, "", "é", "!?", "ж", "中", "_"])).tolist() == [
        True, False, False, False, True, False, True, True, False,
    ]


def test_registered_query_on_held_out_documents(spark):
    from featurelens.llm import queries

    table = {r.doc_id: r for r in spark.read.parquet(f"{SMOKE.replace('0.001', '0.01')}/documents.parquet").collect()}
    got = queries.QUERIES["op13_family_machines"](spark, SMOKE.replace("0.001", "0.01")).collect()
    assert sorted(r.doc_id for r in got) == sorted(table)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out]
    assert sum(r.lang_pred == table[r.doc_id].lang for r in tested) > 0.98 * len(tested)
    # Labels of held-out documents take no part.
    hidden = spark.read.parquet(f"{SMOKE.replace('0.001', '0.01')}/documents.parquet").withColumn(
        "lang", F.when(~identify.held_out("doc_id"), F.col("lang"))
    )
    assert sorted((r.doc_id, r.lang_pred) for r in identify.identify(hidden).collect()) == sorted((r.doc_id, r.lang_pred) for r in got)


def test_brute_force_twin(spark):
    """Predictions of the fitted machines, evaluated one document at a time."""
    rows = spark.read.parquet(f"{SMOKE}/documents.parquet")
    model = identify.fit(rows.filter(~identify.held_out("doc_id")))
    assert sorted(x for xs in model.languages.values() for x in xs) == ["de", "en", "es", "fr"]
    got = {r.doc_id: r for r in identify.predict(rows, model).collect()}
    sigmoid = lambda m: 1 / (1 + np.exp(-2 * m))
    for r in rows.collect():
        x = np.append(grams(r.text), 1)
        margins = model.family_rows @ x
        inside = model.languages[model.families[int(margins.argmax())]]
        a, b = inside
        m = float(model.pairs[a, b] @ x)
        if not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
        elif abs(m) > 1e-4 and abs(np.diff(np.sort(margins)[-2:])[0]) > 1e-4:
            assert got[r.doc_id].lang_pred == (a if m >= 0 else b)
            assert got[r.doc_id].score == pytest.approx(sigmoid(margins.max()) * sigmoid(abs(m)), abs=1e-4)


def test_many_families_and_pairs(spark):
    syllables = {
        "en": "th er ing and", "de": "sch ung ein ich", "nl": "ij aa oe een", "fr": "eau oux é ment", "es": "ción ll ñ ado",
        "xx": "zq qz xk", "ja": "の は",
    }
    rng = np.random.default_rng(2)
    make = lambda s: " ".join("".join(rng.choice(s.split(), 3)) for _ in range(30))
    rows = [(i, make(syllables[x]), x) for i, x in enumerate(list(syllables) * 60)]
    rows += [(1000, rows[0][1], None), (1001, "", "en"), (1002, None, "en"), (1003, "12 34", "de"), (None, make(syllables["fr"]), "fr"), (3, rows[3][1], "fr")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("key", F.lit(1)).withColumn("score", F.lit("s"))
    model = identify.fit(table)
    assert model.families == ["germanic", "only ja", "only xx", "romance"] and len(model.pairs) == 4
    got = identify.identify(table.repartition(7)).collect()
    assert len(got) == len(rows)
    want = {i: x for i, _, x in rows if i is not None and i < 1000}
    assert all(r.lang_pred == want[r.doc_id] for r in got if r.doc_id in want)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (1001, 1002, 1003)} == {i: ("und", 0.0) for i in (1001, 1002, 1003)}
    assert [r.lang_pred for r in got if r.doc_id is None] == ["fr"]


def test_awkward_and_empty_tables(docs, nothing):  # noqa: F811
    got = identify.identify(docs).collect()
    assert len(got) == docs.count() and {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert identify.identify(nothing).count() == 0
    named = docs.withColumn("lang", F.lit("sv"))
    got = identify.identify(named).collect()
    lettered = sum(any(c.isalpha() for c in r.text or "") for r in docs.collect())
    assert sum(r.lang_pred == "sv" for r in got) == lettered and sum(r.lang_pred == "und" for r in got) == len(got) - lettered


def test_copies_do_not_fill_the_sample(spark):
    rows = [(i, "the same text " * 3, "en") for i in range(3000)] + [(5000 + i, f"ordinary words {i} stand here", "en") for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("hash", F.xxhash64("text"))
    few = identify._sampled(table, 100).collect()
    assert 60 < len(few) < 170 and len({r.text for r in few}) == len(few)
