import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from awkward import SMOKE, docs, nothing, texts  # noqa: F401
from featurelens.llm import graph, omh, words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def shingles(text):
    keys, _ = omh.shingles(words.table(pa.array([text or ""])))
    return keys.tolist()


def brute(rows, one_each=False):
    """Least id of the group of every (id, text) row, by comparing all texts.

    ``one_each``: of every group instead.
    """
    texts = sorted({t or "" for _, t in rows})
    own = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = own[i], own[j]
            if min(len(a), len(b)) < 0.8 * max(len(a), len(b)) or not a or len(set(a) & set(b)) < 0.4 * min(len(set(a)), len(set(b))):
                continue
            match = lcs(a, b)
            if match / (len(a) + len(b) - match) >= 0.8 - 1e-9:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for key, text in rows:
        if key is not None:
            least[find(texts.index(text or ""))].append(key)
    if one_each:
        return [(min(least[g], default=None),) * 2 for g in {find(texts.index(text or "")) for _, text in rows}]
    return [(key, min(least[find(texts.index(text or ""))], default=None)) for key, text in rows]


def plain(pairs):
    return sorted((-1 if a is None else a, -1 if b is None else b) for a, b in pairs)


def test_groups_match_brute_force(docs, nothing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.class_id) for r in omh.groups(docs).collect()]
    assert plain(got) == plain(brute(rows))
    assert omh.groups(nothing).count() == 0


def test_keep_one_keeps_the_least_of_each_group(docs, nothing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = omh.keep_one(docs)
    assert kept.columns == docs.columns
    assert plain((r.doc_id, r.doc_id) for r in kept.collect()) == plain(brute(rows, one_each=True))
    assert omh.keep_one(nothing).count() == 0


def test_near_copies_around_a_base_form_the_brute_force_groups(spark):
    rng = random.Random(5)
    base = ["w%d" % rng.randrange(900) for _ in range(70)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(70)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, "w1 w2 " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain((r.doc_id, r.class_id) for r in omh.groups(df).collect()) == plain(brute(rows))


def test_matches_equals_the_full_table_when_enough():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 12, rng.integers(1, 40)).astype(np.uint64)
        b = np.array([x for x in a.tolist() if rng.random() > 0.1] + rng.integers(0, 12, 2).tolist(), np.uint64)
        true = lcs(a.tolist(), b.tolist())
        for need in (1, true, true + 1, omh.needed(len(a), len(b))):
            got = omh.matches(a, b, need)
            assert (got >= need) == (true >= need) and got <= true


def test_links_between_join_what_brute_force_joins():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**60, 40).astype(np.uint64)
    keys = []
    for _ in range(30):
        k = base.copy()
        k[rng.integers(0, 40, rng.integers(0, 8))] = rng.integers(0, 2**60)
        keys.append(k)
    found = omh.links_between(keys, [bytes([i]) for i in range(30)], np.zeros(30, int))
    edges = [(i, j) for i in range(30) for j in range(i) if lcs(keys[i].tolist(), keys[j].tolist()) >= omh.needed(40, 40)]

    def parts(links):
        group = list(range(30))
        for a, b in links:
            old, new = group[a], group[b]
            group = [new if g == old else g for g in group]
        return {frozenset(i for i in range(30) if group[i] == g) for g in group}

    assert parts(found) == parts(edges)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 200)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_registered_query_matches_brute_force(spark):
    from featurelens.llm import queries

    table = spark.read.parquet(f"{SMOKE}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = [(r.doc_id, r.class_id) for r in queries.QUERIES["op6_order_minhash"](spark, SMOKE).collect()]
    assert plain(got) == plain(brute(rows))


def test_links_that_no_sketch_shows_are_found(spark):
    """Pairs at the threshold that agree in none of the sketches."""
    long = "616602 994536 428945 92618 989607 847374 818246 312965 563240 709315 930341 601549 251949 537614 114422 233068 301843 277517 37420 739019"
    short = "445835 353062 612593 637204 26761 771304 689083 960800 800464 953219 75044 30021"
    rows = [(1, f"{long} 38562 246264"), (2, f"{long} 1942229 1354257"), (3, f"{short} 46802"), (4, f"{short} 1404987"), (5, short[:20])]
    drawn = [omh.sketches(*omh.shingles(words.table(pa.array([text]))))[0] for _, text in rows]
    assert not (drawn[0] == drawn[1]).any() and not (drawn[2] == drawn[3]).any()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain((r.doc_id, r.class_id) for r in omh.groups(df).collect()) == plain(brute(rows)) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]
    assert sorted(r.doc_id for r in omh.keep_one(df).collect()) == [1, 3, 5]


def test_links_of_texts_without_a_label_are_kept(spark):
    labels = spark.createDataFrame([(b"a", b"a"), (b"b", b"a")], "node binary, label binary")
    links = spark.createDataFrame([(b"b", b"c"), (b"x", b"y")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.label) for r in omh._merged(labels, links).collect()}
    assert got == {b"a": b"a", b"b": b"a", b"c": b"a", b"x": b"x", b"y": b"x"}


def test_large_prefix_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(omh, "LISTED_TEXTS", 2)
    rng = random.Random(9)
    base = ["w%d" % rng.randrange(900) for _ in range(60)]
    rows = [(i, " ".join(base[: 60 - 2 * i] + [f"v{rng.randrange(10**6)}" for _ in range(2 * i)])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = df.selectExpr("unhex(md5(cast(text AS binary))) AS node", "text")
    none = spark.createDataFrame([], "node binary, label binary")
    found = {bytes(r.node): bytes(r.label) for r in omh._joined_by_prefixes(texts, none, omh.SIMILARITY).collect()}
    node = {r.text: bytes(r.node) for r in texts.collect()}
    group = [found.get(node[t], node[t]) for _, t in rows]
    want = [key for _, key in sorted(brute(rows))]
    assert [group.index(g) for g in group] == [want.index(k) for k in want]


def test_the_order_knows_lines_that_a_small_share_of_a_large_table_holds(spark, monkeypatch):
    """A line of every eighth text ends the order, so it gathers no texts in a prefix bucket."""
    monkeypatch.setattr(omh, "COUNTED_TEXTS", 4)
    rng = random.Random(4)
    line = [f"line{i}" for i in range(12)]
    rows = [(i, " ".join((line if i % 8 == 0 else []) + [f"u{rng.randrange(10**7)}" for _ in range(40)])) for i in range(1600)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("unhex(md5(cast(text AS binary))) AS node", "text")
    common = omh.common_shingles(texts)
    assert set(omh._labelled(pa.array([" ".join(line)]))[0].tolist()) <= set(common.tolist())
    drawn = texts.mapInArrow(omh._prefixes(common, omh.SIMILARITY), "bucket long, node binary, n int")
    assert drawn.groupBy("bucket").count().agg({"count": "max"}).first()[0] < 20


def test_texts_of_the_largest_label_move_once_for_each_block_of_the_others(spark, monkeypatch):
    monkeypatch.setattr(omh, "BLOCK_TEXTS", 5)
    rows = [(1, bytes([i]), 10, b"m") for i in range(40)] + [(1, bytes([100 + i]), 10, bytes([200 + i // 2])) for i in range(4)]
    rows += [(2, bytes([i]), 10, bytes([i])) for i in range(12)] + [(3, bytes([i]), 10, bytes([i])) for i in range(3)]
    opened = spark.createDataFrame(rows, "bucket long, node binary, n int, label binary").join(
        spark.createDataFrame([(1, 9), (2, 3), (3, 1)], "bucket long, blocks int"), "bucket"
    )
    cells = defaultdict(list)
    moved = defaultdict(int)
    for r in omh._cells(opened).collect():
        cells[r.bucket, r.i, r.j].append((bytes(r.node), bytes(r.label), r.own))
        moved[r.bucket, bytes(r.label)] += 1
    assert moved[1, b"m"] == 40 and sum(moved[1, bytes([200 + i])] for i in range(2)) == 4 * 9
    met = defaultdict(int)
    for (bucket, _, _), held in cells.items():
        sides = {own for *_, own in held}
        for x, lx, ox in held:
            for y, ly, oy in held:
                if x < y and lx != ly and (len(sides) == 1 or ox != oy):
                    met[bucket, x, y] += 1
    want = {(b, x, y) for b, x, _, lx in rows for c, y, _, ly in rows if b == c and x < y and lx != ly}
    assert set(met) == want and set(met.values()) == {1}


def test_links_between_a_large_label_and_the_rest():
    """Links that join labels are found whichever label is largest, within and across sides."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**60, 30).astype(np.uint64)
    for trial in range(20):
        keys = []
        for _ in range(24):
            k = base.copy()
            k[rng.integers(0, 30, rng.integers(0, 9))] = rng.integers(0, 2**60)
            keys.append(k)
        label = [b"m" if i % 3 else bytes([i]) for i in range(24)]
        side = np.arange(24) % 2 if trial % 2 else np.zeros(24, int)
        edges = [
            (i, j)
            for i in range(24)
            for j in range(i)
            if (side[i] != side[j] or not trial % 2) and lcs(keys[i].tolist(), keys[j].tolist()) >= omh.needed(30, 30)
        ]

        def parts(links, label=label):
            group = [label.index(x) for x in label]
            for a, b in links:
                group = [group[b] if g == group[a] else g for g in group]
            return {frozenset(i for i in range(24) if group[i] == g) for g in group}

        found = omh.links_between(keys, label, side)
        assert parts(found) == parts(edges) and all((j, i) in edges or (i, j) in edges for i, j in found)


def test_buckets_of_several_blocks_are_joined_as_brute_force_joins(spark, monkeypatch):
    monkeypatch.setattr(omh, "BLOCK_TEXTS", 4)
    monkeypatch.setattr(omh, "LISTED_TEXTS", 2)
    rng = random.Random(31)
    base = ["w%d" % rng.randrange(900) for _ in range(60)]
    rows = []
    for i in range(50):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain((r.doc_id, r.class_id) for r in omh.groups(df).collect()) == plain(brute(rows))
