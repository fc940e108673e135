"""Ids and counts against the library itself, packing against exhaustive search."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roomledger.llm import packing, queries, token_counts
from roomledger.llm.tokens import WordIds, library

TEXTS = [
    None, "", " ", "\n", "  a", "a  ", "a <|endoftext|> b", "x<|endoftext|>  y\n z", "Ünï İstanbul ΣΑΣ ß ﬁ",
    "tab\tsep \n x", "don't DON'T we'll 12 345", "a b　c 😀😀 x", "日本語 テキスト ١٢٣", "a\x1cb c\x85d",
    "<|startoftext|>A <|ENDOFTEXT|>", " ́a", "a​b ﻿c", "  \t\n mixed \r\n lines  end \v\f", "w" * 30_000,
    "the end. " * 9000,
]


def library_ids(path, texts):
    held = library(path).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    return [e.ids for e in held]


def test_counts_equal_the_library(docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "\n"), (None, "no id")]
    got = token_counts.count_tokens(docs_of(rows).repartition(3), queries.BYTES).collect()
    ids = library_ids(queries.BYTES, [t for _, t in rows])
    wanted = [(i, len((t or "").encode()), len(x), len(x) > 1024) for (i, t), x in zip(rows, ids)]
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
    assert token_counts.count_tokens(docs_of([]), queries.BYTES).count() == 0


def test_counts_of_made_up_words(docs_of):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=50))) for i in range(60)]
    got = token_counts.count_tokens(docs_of(rows), queries.BYTES).collect()
    ids = library_ids(queries.BYTES, [t for _, t in rows])
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(x) for (i, _), x in zip(rows, ids)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=50))
def test_packed_numbers_come_back(values):
    data, ends = token_counts.packed(np.array(values, np.int64))
    found, upto = token_counts.unpacked(data)
    assert found.tolist() == values and len(ends) == len(values)
    assert not len(data) or upto[-1] == len(values)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_word_ids_equal_the_library(texts):
    got = WordIds(queries.WORDS)(pa.array(texts, pa.string()))
    assert got == [np.array(x, "<u4").tobytes() for x in library_ids(queries.WORDS, texts)]


@pytest.mark.parametrize("odd", ["\U0003d000", "\U0003ded1\u58eb", "\u0558", "\u208f", "\ufdd0", "\U0010ffff"])
def test_letters_of_a_newer_unicode_count_as_the_library_counts_them(docs_of, odd):
    """``regex`` knows more letters than the tokenizers do."""
    texts = [odd, ":" + odd, odd + ":", "a" + odd, odd + "b 7" + odd, " " + odd + "  " + odd + " c", "é" + odd + "<|endoftext|>" + odd, "it's" + odd]
    texts += [" ".join(texts), "\n".join(texts), "\x85".join(texts)]
    got = WordIds(queries.WORDS)(pa.array(texts, pa.string()))
    assert got == [np.array(x, "<u4").tobytes() for x in library_ids(queries.WORDS, texts)]
    counts = token_counts.count_tokens(docs_of(list(enumerate(texts))), queries.BYTES).collect()
    assert {r.doc_id: r.n_tokens for r in counts} == {i: len(x) for i, x in enumerate(library_ids(queries.BYTES, texts))}


def test_pieces_tile_documents_and_sequences(docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "\n"), (None, "no id")]
    got = packing.pack(docs_of(rows).repartition(2), queries.WORDS, with_ids=True).collect()
    wanted = defaultdict(list)
    for (i, _), ids in zip(rows, library_ids(queries.WORDS, [t for _, t in rows])):
        wanted[i].append(np.array([*ids, 0], "<u4").tobytes())
    whole = defaultdict(lambda: defaultdict(list))
    sequences = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        assert r.start == r.piece * packing.CAPACITY
        whole[r.doc_id][r.piece].append(r.ids)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, copies in wanted.items():
        pieces = [whole[i][p] for p in sorted(whole[i])]
        assert all(b"".join(p) == copies[0] for p in zip(*pieces)) and len(pieces[0]) == len(copies)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(r.length for r in got)
    assert len(sequences) == -(-total // packing.CAPACITY)
    assert packing.pack(docs_of([]), queries.WORDS).count() == 0


def fewest(items, capacity):
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= items[i]}):
            left = list(rooms)
            left[left.index(room)] -= items[i]
            go(i + 1, left)
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_completion_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 50, 100])
    spread = [(1, capacity), (capacity // 5, capacity // 2), (capacity // 3, capacity // 2 + 3)][seed % 3]
    items = sorted((rng.randint(*spread) for _ in range(rng.randint(1, 10))), reverse=True)
    plan = packing.complete_bins(Counter(items), capacity)
    held = Counter()
    for filling, bins in plan:
        assert sum(length * n for length, n in filling) <= capacity
        for length, n in filling:
            held[length] += n * bins
    assert held == Counter(items)
    assert sum(n for _, n in plan) == fewest(items, capacity)
