"""Removal of repeated strings against a plain count of all of them."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roomledger.llm import suffix_dedup


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_ranks_are_those_of_sorted_suffixes(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    ranks = suffix_dedup.suffix_ranks(np.array(text, np.int64))
    assert np.argsort(ranks, kind="stable").tolist() == order


def test_ranks_of_long_texts_and_large_numbers():
    rng = np.random.default_rng(1)
    for text in (rng.integers(1, 5, 4000), np.full(3000, 7), rng.integers(1, 1 << 31, 500), np.tile([3, 1, 2], 900)):
        held = text.tolist()
        order = sorted(range(len(held)), key=lambda i: held[i:])
        assert np.argsort(suffix_dedup.suffix_ranks(text.astype(np.int64))).tolist() == order


def plain(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    strings = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if strings[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        cuts = [p for p in range(len(t) + 1) if (p > 0 and gone[p - 1]) != (p < len(t) and gone[p])]
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), list(zip(cuts[0::2], cuts[1::2])), kept))
    return sorted(out, key=repr)


def got(df):
    rows = [(r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in df.collect()]
    return sorted(rows, key=repr)


def corpus(seed, length):
    rng = random.Random(seed)
    shared = ["".join(rng.choices("abé 日", k=rng.randrange(2 * length))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice(shared) if rng.random() < 0.4 else "".join(rng.choices("abcd efg", k=rng.randrange(length))) for _ in range(rng.randrange(6))]
        rows.append((i, "".join(parts)))
    rows += [(300 + i, shared[0] + str(i) * 3 + shared[1]) for i in range(30)]
    rows += [(400, None), (401, ""), (402, "x" * (length - 1)), (403, "y" * length), (404, "z" * (length + 1))]
    rows += [(405, "go on " * 400), (406, "go on " * 90), (407, "q" * 3000), (7, rows[7][1]), (7, "other"), (None, rows[9][1])]
    return rows


@pytest.mark.parametrize("length,stretches", [(200, 8192), (24, 8192), (24, 2), (9, 1)])
def test_equals_a_count_of_all_strings(docs_of, monkeypatch, length, stretches):
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 3000)
    rows = corpus(length, length)
    df = suffix_dedup.remove_repeats(docs_of(rows).repartition(4), length=length, stretches=stretches)
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    assert got(df) == plain(rows, length)


def test_blocks_and_no_rows(docs_of, monkeypatch):
    rows = corpus(5, 40)
    want = plain(rows, 40)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1)
    assert got(suffix_dedup.remove_repeats(docs_of(rows), length=40)) == want
    assert suffix_dedup.remove_repeats(docs_of([])).count() == 0
    assert suffix_dedup.remove_repeats(docs_of([(1, "a"), (2, None)])).count() == 2


def test_documents_that_touch_do_not_join(docs_of):
    half = "".join(random.Random(4).choices("abcdefgh", k=100))
    rows = [(1, half), (2, half), (3, half + half), (4, "-" + half + half)]
    assert got(suffix_dedup.remove_repeats(docs_of(rows).coalesce(1))) == plain(rows, 200)


def words(seed, n):
    return "".join(random.Random(seed).choices("abcdefghijklmnop ", k=n))


def test_stretches_that_recur_as_a_whole_are_not_sorted(docs_of, monkeypatch):
    """A copy in another block or in the same one needs no sorting; where a passage begins or
    ends inside other text, only the stretches at its edges do."""
    sent = []
    plainly = suffix_dedup.repeated_runs

    def counted(texts, *more):
        sent.append(texts.count())
        return plainly(texts, *more)

    monkeypatch.setattr(suffix_dedup, "repeated_runs", counted)
    copies = [(i, words(i % 7, 3000)) for i in range(21)]
    edges = [(30, words(30, 900) + words(31, 4000) + words(32, 900)), (31, words(33, 700) + words(31, 4000) + words(34, 700))]
    for most in (1, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", most)
        assert got(suffix_dedup.remove_repeats(docs_of(copies))) == plain(copies, 200)
        assert got(suffix_dedup.remove_repeats(docs_of(copies + edges))) == plain(copies + edges, 200)
    assert sent[0] == sent[2] == 0
    assert 0 < max(sent) <= 8


def test_a_block_is_hashed_once(monkeypatch):
    texts = [words(1, 700).encode(), b"", words(2, 300).encode() + words(1, 700).encode()]
    held = pa.Table.from_batches([suffix_dedup._block(200, 5, [1, 2, None], texts)])
    run = max(held["runs"][0].as_py(), key=lambda r: r["begin"])
    for name in ("runs_of", "_hashes", "_stretch"):
        monkeypatch.setattr(suffix_dedup, name, None)
    row = {"core": run["core"], "block": 5, "begin": run["begin"], "starts": run["starts"], "twice": False}
    sent = pa.Table.from_pylist([row], suffix_dedup._TEXTS.remove(4).insert(3, pa.field("starts", pa.int32())))
    text = suffix_dedup._texts(200, held, sent)["text"].to_pylist()
    assert text == [b"".join(texts)[run["begin"] :][: run["starts"] + 199]]
    left = suffix_dedup._cut(200, held, suffix_dedup._FOUND_ARROW.empty_table()).to_pylist()
    assert [r["doc_id"] for r in left] == [1, 2, None]
    assert 0 < left[0]["n_removed"] < 700 and left[0]["n_removed"] == left[2]["n_removed"]


@pytest.mark.parametrize("length", [1, 9, 40, 200])
def test_runs_do_not_depend_on_the_hashed_parts(monkeypatch, length):
    rng = np.random.default_rng(length)
    for letters in (1, 2, 20):
        sizes = rng.integers(0, 3 * length, 25)
        text = rng.integers(97, 97 + letters, sizes.sum()).astype(np.uint8)
        whole = suffix_dedup.runs_of(text, sizes, length)
        begin, end, core, _ = whole
        hashes = suffix_dedup._hashes(text, max(1, length // 5)).view(np.int64)
        ends = np.cumsum(sizes)
        strings = [p for a, b in zip(ends - sizes, ends) for p in range(a, b - length + 1)]
        assert [p for a, b in zip(begin, end) for p in range(a, b)] == strings
        for a, b, c in zip(begin, end, core):
            for p in range(a, b):
                assert hashes[p : p + length - max(1, length // 5) + 1].view(np.uint64).min() == c.view(np.uint64)
        monkeypatch.setattr(suffix_dedup, "HASHED", 37)
        assert all((a == b).all() for a, b in zip(whole, suffix_dedup.runs_of(text, sizes, length)))
        monkeypatch.undo()


def test_joined_spans_stay_in_their_documents():
    sizes = np.array([0, 10, 0, 10, 5])
    owner, begin, end = suffix_dedup._spans(sizes, np.array([14, 2, 10, 4, 0, 20]), np.array([18, 6, 14, 10, 1, 25]))
    assert list(zip(owner.tolist(), begin.tolist(), end.tolist())) == [(1, 0, 1), (1, 2, 10), (3, 10, 18), (4, 20, 25)]
