from __future__ import annotations

import hashlib
import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roomledger.llm import chat_format, mixing, queries, topk
from tests.compare import differences

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score string"


def best(rows, k):
    usable = [
        (i, [int((1024 * x) // 1) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and abs(x) < 1e300 for x in v)
    ]
    found = set()
    for q, x in usable:
        if q % 10 == 0:
            scores = [(-sum(a * b for a, b in zip(x, y)), i) for i, y in usable if i != q]
            found |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return found


@pytest.mark.parametrize("blocks", [4096, 7])
def test_top_k_equals_all_products(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 3 * blocks)
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (210, []), (211, [0.5, None]), (212, [float("nan")]), (213, [float("inf")])]
    rows += [(220, [0.0] * 6), (230, [0.5, 0.25]), (None, [1.0]), (214, [0.001, -0.001])]
    # as floats hold them
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VECTORS)
    held = [(r.vec_id, r.embedding) for r in frame.collect()]
    got = topk.top_k(frame, F.col("vec_id") % 10 == 0, k=4).collect()
    assert {tuple(r) for r in got} == best(held, 4) and len(got) == len(best(held, 4))
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_repeated_vectors(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])]
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VECTORS)
    got = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2097152), (0, 2, 1, 2097152)]


def test_repeated_query_among_many_candidates(spark):
    # the query's own rows have the highest products of one block
    rows = [(0, [9.0])] * 200 + [(i, [i / 64]) for i in range(1, 200)]
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VECTORS)
    got = topk.top_k(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(199, 189, -1))


TURNS = [
    (1, 1, "user", "plain"), (1, 2, "assistant", "two\nlines"), (1, 3, "assistant", None),
    (2, 1, "user", "\\### Assistant: </turn> ok"), (2, 2, "assistant", "\\\\</turn>\n### x </turn"),
    (3, 2, None, "\\"), (3, 2, "a:b\\c\nd", ""), (3, 1, "assistant", "ends with \\"), (3, 1, "assistant", "twin"),
    (3, 1, "assistant", "twin"), (4, 1, "user", "no answer"), (5, None, "assistant", "😀 é\n</turn>\n"),
    (6, 1, "assistant", "</turn>" * 4000), (None, 1, "user", "no id"), (7, 1, "assistant", "\n"),
    (8, 1, "user", ": ### "), (8, 2, "assistant", "$1 \\1 \\\\ ###"),
]


def test_format_reads_back(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, place int"
    rows = spark.createDataFrame([(*r, "x", 1) for r in TURNS], schema)
    made = chat_format.format_conversations(rows)
    assert all(r.faithful for r in made.collect())
    got = {r.conv_id: r for r in chat_format.digests(made).collect()}
    by_conversation = {}
    for conv, turn, role, text in TURNS:
        key = (turn is not None, turn or 0, role or "", text or "")
        by_conversation.setdefault(conv, []).append(key)
    for conv, turns in by_conversation.items():
        turns = sorted(turns)
        read = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        row = got[conv]
        assert (row.n_turns, row.loss_chars) == (len(turns), len(loss))
        assert row.turns_sha256 == hashlib.sha256(read.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    texts = {r.conv_id: r for r in made.collect()}
    assert got[6].formatted_chars == len(texts[6].formatted) == 4000 * 8 + len("### assistant: \n</turn>\n")
    for row in made.collect():
        raw = row.formatted.encode()
        for s in row.loss_spans or []:
            assert row.formatted[s.start : s.end] == raw[s.first_byte : s.end_byte].decode()
    assert chat_format.digests(chat_format.format_conversations(rows.limit(0))).count() == 0


def test_format_plan_is_native(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    plan = chat_format.digests(chat_format.format_conversations(rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, "": 2.0}, {"a": 1.0, "b": 0.0}])
def test_mixture_deviates_by_less_than_a_block(spark, docs_of, weights):
    rows = [(i, "t", "en", "a" if i % 3 else "b") for i in range(900)] + [(900 + i, "t", "en", None) for i in range(60)]
    rows += [(5, "t", "en", "a"), (None, "t", "en", "a")]
    got = mixing.schedule(docs_of(rows), weights, block=4, cycle=64).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    found = mixing.shares(sizes, weights, 64)
    cycle = sum(found.values())
    blocks = {}
    for r in got:
        if r.source not in found:
            assert r.slot is None and not r.in_mix
            continue
        assert r.release <= r.slot < r.deadline
        blocks.setdefault((r.source, r.block), set()).add(r.slot)
        assert 0 <= r.position < 4
    assert all(len(s) == 1 for s in blocks.values())
    slots = {s.pop(): source for (source, _), s in blocks.items()}
    assert len(slots) == len(blocks)
    horizon = sum(1 for s in slots if any(r.slot == s and r.in_mix for r in got))
    had = dict.fromkeys(found, 0)
    for slot in range(horizon):
        had[slots[slot]] += 1
        for s, share in found.items():
            assert abs(had[s] - Fraction(share * (slot + 1), cycle)) < 1


def test_mixed_keeps_the_mixture_whole(docs_of):
    rows = [(i, "t", "en", "a" if i % 4 else "b") for i in range(400)]
    docs = docs_of(rows)
    wanted = {r.doc_id for r in mixing.schedule(docs).where("in_mix").collect()}
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == wanted
    assert mixing.mixed(docs_of([])).count() == 0 == mixing.schedule(docs_of([])).count()


def test_stage_keeps_documents_after_the_smallest_source(docs_of):
    rows = [(i, "t", "en", "a" if i % 4 else "b") for i in range(2000)] + [(5000, "t", "en", None)]
    rows += [(5, "t", "en", "b"), (None, "t", "en", "a")]
    docs = docs_of(rows).repartition(3)
    kept = corpus_pipeline.mix_sources(None, docs, "").collect()
    assert sorted(map(repr, ((r.doc_id, r.source) for r in kept))) == sorted(repr((r[0], r[3])) for r in rows)
    slots = {(r.doc_id, r.source): (r.slot, r.position) for r in mixing.schedule(docs).collect()}
    order = [slots[r.doc_id, r.source or ""] for r in kept]
    assert order == sorted(order) and not all(r.in_mix for r in mixing.schedule(docs).collect())


def test_packing_follows_the_mixture(spark, docs_of, tmp_path):
    """The order of the mixing stage decides which sequence a document is in, and its number."""
    words = ["one", "two words", "three words here", "x " * 900, "y " * 2500, "z " * 700]
    docs = docs_of([(i, words[i * i % 6], "en", "a" if i % 4 else "b") for i in range(300)] + [(7, "one", "en", "c"), (None, None, "en", None)])
    packed = {}
    for name, rows in (("mixed", corpus_pipeline.mix_sources(spark, docs, "")), ("plain", docs.orderBy("doc_id"))):
        rows.write.parquet(f"{tmp_path}/{name}")
        order = [r.doc_id for r in rows.collect()]
        got = corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/{name}"), "").collect()
        first: dict = {}
        held: dict = {}
        for r in got:
            first[r.sequence_id] = min(first.get(r.sequence_id, 999), order.index(r.doc_id))
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert [first[k] for k in sorted(first)] == sorted(first.values()) and sorted(first) == list(range(len(first)))
        for pieces in held.values():
            ends = [0, *(a + n for a, n in sorted(pieces))]
            assert [a for a, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048
        packed[name] = sorted((repr(r.doc_id), r.piece, r.length, r.ids_crc32, r.sequence_id) for r in got)
    assert [x[:4] for x in packed["mixed"]] == [x[:4] for x in packed["plain"]] and packed["mixed"] != packed["plain"]


def test_control_strings_are_escaped_as_in_sql(spark, tmp_path):
    texts = ["### system: x", "a </turn> b", "</turn>x", "####", "#\\####", "##\\####", "\\\\### </turn>\n", "######"]
    texts += ["</turn></turn> \\</turn>", "</turn>\n", "## # </turn", None, "plain"]
    rows = [(i, n, role, t) for i, t in enumerate(texts) for n, role in enumerate(["user", "assistant"])]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    name = "op5_chat_format"
    assert not differences(queries.QUERIES[name](spark, str(tmp_path)), con, queries.SQL[name])
    assert all(r.faithful for r in chat_format.format_conversations(frame).collect())
