from __future__ import annotations

import hashlib
import random

import pytest

from roomledger.llm.exact_dedup import drop_exact_copies, exact_groups, grouped

LONG = "Word " * 40_000


def expected(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault((text or "").encode().lower(), []).append((doc_id is not None, doc_id or 0, i))
    found = []
    for content, members in groups.items():
        known, keep, _ = max(members, key=lambda m: m[:2])
        for k, doc_id, _ in members:
            found.append((doc_id if k else None, keep if known else None, len(members)))
            found[-1] += (hashlib.sha256(content).hexdigest(),)
    return sorted(found, key=repr)


@pytest.mark.parametrize("budget", [1, 500, 1 << 20])
def test_equals_brute_force(docs_of, budget):
    rows = [(1, None), (2, ""), (3, "Ä a"), (4, "ä a"), (5, "Ä A"), (5, "Ä A"), (6, LONG), (7, LONG.upper())]
    rows += [(None, "x"), (8, "X"), (9, "y "), (10, "y")] + [(100 + i, f"t{i % 40}") for i in range(400)]
    got = exact_groups(docs_of(rows).repartition(4), budget=budget).collect()
    cells = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got]
    assert sorted(cells, key=repr) == expected(rows)
    # one row of a group stays, and it is the one with the largest id
    stays = [r for r in got if r.kept]
    assert len(stays) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in stays)


def test_empty_table_and_stage(docs_of):
    assert exact_groups(docs_of([])).count() == 0
    docs = docs_of([(1, "a"), (2, "A"), (3, "b"), (4, None), (5, "")])
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]


def test_spill_recursion_is_complete():
    rng = random.Random(4)
    records = [(str(rng.randrange(300)).encode() * 20, str(i).encode()) for i in range(3000)]
    got = {content: sorted(members) for content, _, members in grouped(iter(records), budget=2000)}
    wanted = {}
    for content, member in records:
        wanted.setdefault(content, []).append(member)
    assert got == {c: sorted(m) for c, m in wanted.items()}


def test_stage_keeps_one_row_of_repeated_ids(docs_of):
    rows = [(1, "once"), (2, "Twice"), (2, "tWICE"), (2, "twice"), (3, "twice"), (3, "other"), (4, "Other"), (4, "other")]
    rows += [(None, "no id"), (None, "no id"), (None, "once"), (None, None), (5, "Ä"), (5, "ä"), (6, LONG), (6, LONG.upper())]
    rows += [(100 + i % 20, f"t{i % 30}") for i in range(120)]
    docs = docs_of(rows).repartition(5)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "").encode().lower()) for r in kept.collect()), key=repr)
    wanted = {}
    for doc_id, text in rows:
        content = (text or "").encode().lower()
        wanted[content] = max(wanted.get(content, (False, 0)), (doc_id is not None, doc_id or 0))
    assert got == sorted(((i if known else None, c) for c, (known, i) in wanted.items()), key=repr)
