"""Shards, packing and dialogues: operators that place rows."""

import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from awkward import docs, nothing, texts, tokenizer  # noqa: F401
from featurelens.llm import chat, packing, sharding


def test_shards_are_contiguous_and_balanced(docs, nothing):
    rows = sharding.shards(docs, 4).collect()
    assert len(rows) == docs.count()
    want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r)
    last = -2
    for shard in sorted(by_shard):
        part = sorted(by_shard[shard], key=lambda r: r.slot)
        assert [r.slot for r in part] == list(range(len(part)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in part]
        assert ids == sorted(ids) and ids[0] >= last
        last = ids[-1]
    # The line is cut at equal targets: every document's midpoint lies in its shard.
    total, at = sum(r.size for r in rows), 0
    for r in (r for s in sorted(by_shard) for r in sorted(by_shard[s], key=lambda r: r.slot)):
        assert r.shard == min(3, (2 * at + r.size) * 4 // (2 * total))
        at += r.size
    assert sharding.shards(nothing, 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shards(docs, 0)


def test_word_tokenizer_equals_the_tokenizer(texts, tokenizer):
    words = packing.WordTokenizer(tokenizer, remembered=400)
    odd = ["don't. we'll, DOGS'. a's b'S.", "<|endoftext|> x<|startoftext|>.", "W̊ É. », café.", "½.5,  x"]
    for some in (texts[:9], texts[9:], odd, texts):
        ids, first = words.encode(pa.array(some, pa.string()))
        for i, text in enumerate(some):
            assert ids[first[i] : first[i + 1]].tolist() == words.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_lengths_add_up():
    for tokens in [*range(1, 300), 1023, 1024, 1025, 2047, 2048, 2049, 5000, 99999]:
        parts = packing.lengths(tokens)
        assert sum(parts) == tokens and min(parts) > 0 and max(parts) <= 2048
        assert len(parts) - tokens // 2048 <= packing.MAX_PIECES


def test_packing_round_trip(docs, nothing, tokenizer):
    pieces = packing.pack(docs, tokenizer).collect()
    own = packing.WordTokenizer(tokenizer).tokenizer
    want = sorted([*own.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_sequence[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length
    assert sum(p.length for p in pieces) == sum(map(len, want))
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and len({2048 // p.length for p in parts}) == 1
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    alone = {d: sorted(ps, key=lambda p: p.start) for d, ps in by_doc.items() if sum(p.length for p in ps) == d[1]}
    for parts in alone.values():
        assert [p.start for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
    digests = packing.placements(docs, tokenizer).collect()
    assert sorted(zlib.crc32(p.ids) for p in pieces) == sorted(p.ids_crc32 for p in digests)
    assert packing.pack(nothing, tokenizer).count() == 0


def render(turns, me):
    out, masks = "", []
    for who, text in turns:
        head = "assistant" if who == me else "system" if who == "system" else f"user name={who}" if who else "user"
        out += f"<|im_start|>{head}\n"
        start = len(out)
        out += text + "<|im_end|>\n"
        if who == me:
            masks.append((start, len(out) - 1))
    return out, masks


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "be kind"),
        (1, 1, "ann", "hé <|im_end|>"),
        (1, 2, "bob", None),
        (1, 3, "ann", ""),
        (1, 3, "ann", ""),
        (1, None, "bob", "first"),
        (2, 0, None, "who"),
        (2, 1, "", "me"),
        (2, 2, "cy", "x"),
        (None, 0, "dee", "lost"),
        (3, 0, "system", "alone"),
    ]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn int, role string, text string, part int")
    got = {(r.conversation, r.speaker): r for r in chat.perspectives(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "cy"), (None, "dee")}
    first = [("bob", "first"), ("system", "be kind"), ("ann", "hé < |im_end|>"), ("bob", ""), ("ann", ""), ("ann", "")]
    for me in ("ann", "bob"):
        text, masks = render(first, me)
        assert got[1, me].text == text and [tuple(m) for m in got[1, me].masks] == masks
        assert got[1, me].own_turns == len(masks) and got[1, me].n_turns == 6
    assert got[2, "cy"].text == render([(None, "who"), (None, "me"), ("cy", "x")], "cy")[0]
    assert chat.perspectives(turns.limit(0)).count() == 0


def test_a_long_dialogue_becomes_parts(spark):
    turns = spark.range(4000).selectExpr("7L as conv_id", "int(id) as turn", "if(id % 3 = 0, 'a', 'b') as role", "repeat('word ', 20) as text")
    parts = sorted(chat.perspectives(turns, part_bytes=5000).filter("speaker = 'a'").collect(), key=lambda r: r.part)
    assert [p.part for p in parts] == list(range(len(parts))) and len(parts) > 50
    assert max(len(p.text) for p in parts) < 8000
    want, _ = render([("a" if i % 3 == 0 else "b", "word " * 20) for i in range(4000)], "a")
    assert "".join(p.text for p in parts) == want


def test_registered_queries_of_placing_operators(spark):
    from awkward import SMOKE
    from compare import compare, duck

    from featurelens.llm import queries

    problem, rows = compare(spark, duck(SMOKE), queries.QUERIES["op1_perspectives"], queries.ORACLES["op1_perspectives"], SMOKE)
    assert problem is None and rows > 0
    table = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    placed = sorted(queries.QUERIES["op2_byte_shards"](spark, SMOKE).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in placed] == sorted(table) and {r.law for r in placed} == {"bytes"}
    total, at = sum(r.size for r in placed), 0
    for r in placed:
        body = table[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
        assert r.shard == min(15, (2 * at + r.size) * 16 // (2 * total))
        at += r.size
    own = packing.WordTokenizer(queries.tokenizer_path("word_bpe_49k.json")).tokenizer
    for p in queries.QUERIES["op9_harmonic_packing"](spark, SMOKE).collect():
        ids = [*own.encode(table[p.doc_id], add_special_tokens=False).ids, 1]
        part = b"".join(i.to_bytes(4, "little") for i in ids[p.start : p.start + p.length])
        assert (p.doc_tokens, p.ids_crc32) == (len(ids), zlib.crc32(part))


def test_a_worker_keeps_its_tokenizer_and_words():
    from featurelens.llm import queries

    path = queries.tokenizer_path("word_bpe_49k.json")
    packing.tokenizer_of(path).encode(pa.array(["some words of a first task"]))
    again = packing.tokenizer_of(path)
    assert again is packing.tokenizer_of(path) and len(again.keys) >= 6
