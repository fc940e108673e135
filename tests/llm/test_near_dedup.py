from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from roomledger.llm import near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CASE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(CASE))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def groups(rows):
    """``doc_id -> (n_shingles, component)`` by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def check(rows, docs):
    got = near_dedup.near_groups(docs).collect()
    wanted = groups(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == wanted[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def changed(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


def test_equals_all_pairs(docs_of):
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one two"), (4, "ONE  two"), (5, "two one"), (5, "two one")]
    rows += [(6, "a b c d e"), (7, "a b c d e"), (8, "a b c d e f"), (9, "A\x0bb c d e"), (None, "a b c d e")]
    rows += [(10, "x " * 30_000), (11, "X " * 30_001), (12, "é b c d e"), (13, "É b c d e")]
    for group in range(8):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.choice([30, 150, 400]))]
        for member in range(12):
            rows.append((100 + 20 * group + member, " ".join(changed(base, rng, rng.randrange(len(base) // 60 + 2)))))
    check(rows, docs_of(rows).repartition(5))


def template(rng, n, edits, words=200):
    """Rows that change ``edits`` places of one text each."""
    base = [f"t{i}" for i in range(words)]
    return [" ".join(changed(base, rng, edits)) for _ in range(n)]


def test_rows_of_a_template_do_not_meet(spark, docs_of, monkeypatch):
    """Similar but unlinked rows: what is compared grows with the rows, not with their pairs."""
    asked = {}
    whole = near_dedup._links

    for n in (150, 600):
        def counted(pairs, texts, percent, n=n):
            asked[n] = asked.get(n, 0) + pairs.count()
            return whole(pairs, texts, percent)

        monkeypatch.setattr(near_dedup, "_links", counted)
        rng = random.Random(n)
        rows = list(enumerate(template(rng, n, 4)))
        if n == 150:
            check(rows, docs_of(rows))
        else:
            got = near_dedup.near_groups(docs_of(rows))
            assert got.where("kept").count() > n / 2
    assert asked[600] < 8 * max(asked[150], 150)


def test_links_far_from_the_head(docs_of):
    """Clusters around a template's variants, whose rows are linked with each other only."""
    rng = random.Random(11)
    rows = []
    for variant, text in enumerate(template(rng, 12, 4, 150)):
        for member in range(8):
            words = changed(text.split(), rng, rng.randrange(3))
            rows.append(((variant * 8 + member) * 37 % 1009, " ".join(words)))
    check(rows, docs_of(rows).repartition(3))


def test_chains_and_stars_in_one_bucket(docs_of):
    """Near copies of near copies, far from the smallest id of their buckets."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    rows, chain = [], list(words)
    for i in range(60):
        rows.append((i * 7 % 61, " ".join(chain)))
        chain = changed(chain, rng, 2)
    for i in range(60):
        rows.append((100 + i, " ".join(changed(words, rng, 3))))
    check(rows, docs_of(rows))


def test_steps_without_work_are_skipped(docs_of, monkeypatch):
    """Every action costs the driver memory: sets are made once for all rows of mixed buckets,
    and links within a component and buckets without any are not followed up."""
    made = []
    whole = near_dedup.stored

    def counted(rows, what="table"):
        made.append(what)
        return whole(rows, what)

    monkeypatch.setattr(near_dedup, "stored", counted)
    rng = random.Random(11)
    rows = []
    for variant, text in enumerate(template(rng, 12, 4, 150)):
        rows += [((variant * 8 + m) * 37 % 1009, " ".join(changed(text.split(), rng, m % 3))) for m in range(8)]
    check(rows, docs_of(rows).repartition(3))
    assert made.count("pairs") == 4 and made.count("shingles") == 2
    made.clear()
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(20)]
    check(rows, docs_of(rows))
    assert made == ["signatures", "classes", "representatives", "pairs", "buckets"]


def test_signatures_estimate_similarity(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(600)]
    rows = [(i, " ".join(changed(words, rng, 8 * i))) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    held = frame.mapInArrow(near_dedup._signed, near_dedup.SIGNED)
    bits = held.select("doc_id", "bits")
    pairs = bits.crossJoin(bits.select(F.col("doc_id").alias("o"), F.col("bits").alias("other")))
    for r in pairs.select("doc_id", "o", near_dedup.estimate(F.col("bits"), F.col("other")).alias("e")).collect():
        a, b = shingles(rows[r.doc_id][1]), shingles(rows[r.o][1])
        assert abs(r.e - len(a & b) / len(a | b)) < 0.2
    assert near_dedup.lowest_estimate() < 0.75


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, 300), (300, 250), (7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in near_dedup.components(frame).collect()}
    assert got == {i: 0 for i in range(91)} | {200: 200, 250: 200, 300: 200}
    assert near_dedup.components(frame.limit(0)).count() == 0


def test_stage_and_empty_table(docs_of):
    docs = docs_of([(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, "other")])
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert near_dedup.near_groups(docs_of([])).count() == 0


def test_stage_decides_rows_of_repeated_ids(docs_of):
    words = [f"w{i}" for i in range(100)]
    near, far = " ".join([*words[:-1], "x"]), " ".join(f"v{i}" for i in range(50))
    rows = [(5, " ".join(words)), (5, near), (5, far), (7, near), (7, "alone"), (9, far), (None, near), (None, near)]
    kept = near_dedup.drop_near_copies(docs_of(rows).repartition(3))
    assert kept.columns == docs_of(rows).columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(i for i, _ in got if i) == [5, 5, 7] and len(got) == 5
    assert {(5, far), (7, "alone"), (None, near)} <= set(got)
