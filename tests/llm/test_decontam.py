import math
import re
from collections import Counter

import pytest
from awkward import SMOKE, docs, nothing, prose, texts  # noqa: F401

from featurelens.llm import decontam

WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def grams(words, width=5):
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def holds(words, strings):
    width = len(next(iter(strings))) if strings else 0
    own = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
    return len(strings & own) / len(strings) if strings else 0.0


def brute(documents, items):
    """All verified pairs, scoring every passage against every item."""
    bags = [(key, Counter(terms(text)), text) for key, text in items if terms(text)]
    df = Counter(t for _, bag, _ in bags for t in bag)
    mean = sum(sum(b.values()) for _, b, _ in bags) / max(1, len(bags))
    shares = []
    for key, bag, text in bags:
        size = sum(bag.values())
        w = {
            t: math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
            for t, tf in bag.items()
        }
        shares.append((key, {t: x / sum(w.values()) for t, x in w.items()}, text))
    out = []
    for doc, text in documents:
        words = terms(text)
        passages = [set(words[i : i + 96]) for i in range(0, len(words), 48)]
        for key, share, item in shares:
            score = max((sum(share.get(t, 0) for t in p) for p in passages), default=0)
            if score >= 0.6 - 1e-9:
                question, answer = decontam.split_item(item)
                overlaps = holds(words, grams(terms(question))), holds(words, grams(terms(answer)))
                if min(overlaps) >= 0.6:
                    out.append((-1 if doc is None else doc, key, round(score, 9)))
    return sorted(out)


@pytest.fixture(scope="module")
def case(spark, docs, texts):  # noqa: F811
    items = [
        (1, " ".join(texts[2].split()[5:25]) + ". " + " ".join(texts[2].split()[25:31])),
        (2, re.sub("[a-z]", lambda m: m[0].upper(), " ".join(texts[31].split()[4000:4040]))),
        (3, " ".join(texts[4].split()[:12])),
        (3, " ".join(texts[4].split()[:12])),
        (4, "one"),
        (5, "words that nobody wrote anywhere else. At all."),
        (6, None),
        (7, " ... "),
        (None, " ".join(texts[6].split()[3:20])),
    ]
    table = spark.createDataFrame([(k, t, "x", 1) for k, t in items], "item_id long, text string, question string, doc_id int")
    return table, items


def test_leaks_match_brute_force(docs, nothing, case):  # noqa: F811
    table, items = case
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(-9 if k is None else k, t) for k, t in items])
    assert {k for _, k, _ in want} >= {1, 2, 3, -9}
    for part_items in (4096, 2):
        got = decontam.leaks(docs, table, part_items=part_items).na.fill(-1, ["doc_id"]).na.fill(-9, ["item_id"]).collect()
        assert sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in got) == want
    assert decontam.leaks(nothing, table).count() == 0 and decontam.leaks(docs, table.limit(0)).count() == 0


def test_clean_drops_the_leaks_only(docs, case):  # noqa: F811
    table, items = case
    rows = [(i, r.text) for i, r in enumerate(docs.collect())]
    bad = {d for d, _, _ in brute(rows, [(0, t) for _, t in items])}
    clean = decontam.clean(docs, table, part_items=3)
    assert clean.columns == docs.columns
    assert Counter(r.text for r in clean.collect()) == Counter(t for i, t in rows if i not in bad)


def test_an_answer_column_must_be_held_too(spark):
    words = prose(__import__("random").Random(3), 30)
    table = spark.createDataFrame([(1, words, "yes it is"), (2, words, "never said"), (3, words, None)], "item_id long, text string, answer string")
    one = spark.createDataFrame([(5, f"{words} and yes it is so")], "doc_id long, text string")
    assert sorted(r.item_id for r in decontam.leaks(one, table, answer="answer").collect()) == [1, 3]


def test_registered_query_matches_brute_force(spark):
    from featurelens.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMOKE}/benchmark.parquet").collect()]
    got = queries.QUERIES["op4_block_max_wand"](spark, SMOKE).collect()
    assert sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in got) == brute(rows, items)


def test_copied_items_of_any_length_are_found(spark):
    rng = __import__("random").Random(5)
    other = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    items, rows, want = [(i, "the end") for i in range(900, 940)], [], set()
    for size in (60, 96, 100, 160, 200, 500, 3000):
        body = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        # All weight at the ends: a passage that holds most words of this item holds half of its score.
        skewed = body[:10] + ["the"] * (size - 20) + [w[::-1] for w in body[-10:]]
        for item, copied in ((size, body), (-size, skewed)):
            items.append((item, " ".join(copied)))
            for n in (0, 7, 24, 30, 47):
                want.add((len(rows), item))
                rows.append((len(rows), " ".join(other(n) + copied + other(70))))
        rows.append((len(rows), " ".join(body[: size // 3] + other(300))))
    table = spark.createDataFrame(items, "item_id long, text string")
    documents = spark.createDataFrame(rows, "doc_id long, text string").coalesce(4)
    for part_items in (4096, 200):
        got = [(r.doc_id, r.item_id) for r in decontam.leaks(documents, table, part_items=part_items).collect()]
        assert len(got) == len(set(got)) and {p for p in got if p[1] > 0 and p[1] < 900 or p[1] == 3000} == {p for p in want if p[1] > 0}
        assert want <= set(got)
