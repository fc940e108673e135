"""Importance resampling and source divergence against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roomledger.llm import divergence, resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "A", "a  B\tc", "ÄÖ İx ß ſ", "日本 語", "1-2_3", "don't stop", "x" * 20_000, "go on " * 9000, "\x00a\x7fb\x80c"]


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return Counter(zlib.crc32(r.encode()) for r in runs), len(words)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 .-_é日\n\x00", max_size=60))
def test_scan_finds_all_runs(text):
    found, words = resampling.hashes(text.encode())
    assert (Counter(found), words) == plain_features(text)


def plain_resample(rows, target, percent=5, least=20):
    per_row = [plain_features(t) for _, t in rows]
    have, aim = Counter(), Counter()
    for f, _ in per_row:
        for c, n in f.items():
            have[c % 10_000] += n
    for t in target:
        for c, n in plain_features(t)[0].items():
            aim[c % 10_000] += n
    s_all, t_all = sum(have.values()), sum(aim.values())

    def gain(b):
        return math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10_000) / ((have[b] + 1) * (t_all + 10_000))))

    out = []
    for (i, _), (f, words) in zip(rows, per_row):
        weight = sum(gain(c % 10_000) * n for c, n in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, sum(f.values()), weight, score, None, words])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[2], r[1]))
    for rank, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_resampling_equals_plain_python(spark, docs_of, percent):
    rng = random.Random(percent)
    words = ["".join(rng.choices("abcdé", k=3)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(80)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(3, rows[3][1]), (3, "other"), (None, rows[5][1])]
    target = [" ".join(rng.choices(words[:9], k=30)) for _ in range(5)] + [None, ""]
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs_of(rows).repartition(5), aims, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(rows, target, percent)


def test_resampling_of_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs_of([]), none).count() == 0
    rows = [(i, "a b c " * 10) for i in range(40)]
    got = sorted(map(tuple, resampling.resample(docs_of(rows), none).collect()), key=repr)
    assert got == plain_resample(rows, [])


def plain_divergence(rows, least, top):
    per = defaultdict(Counter)
    used_in = defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        per[lang, source].update(terms)
        used_in[lang].update(set(terms))
    out = []
    for (lang, source), counts in per.items():
        kept = [t for t, n in used_in[lang].items() if n >= least]
        mates = {s: c for (g, s), c in per.items() if g == lang}

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        own, whole = shares(counts), shares(sum(mates.values(), Counter()))
        pairs = [(-sum(abs(own[t] - o[t]) for t in kept), s) for s, o in ((s, shares(c)) for s, c in mates.items()) if s != source]
        terms = sorted((whole[t] - own[t], t) for t in kept if counts[t] and own[t] > whole[t])
        for part, found in (("pair", pairs), ("term", terms[:top])):
            out += [(lang, source, part, i, -v, r) for r, (v, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(32, 4096), (2, 3), (1, 1)])
def test_divergence_equals_plain_python(docs_of, blocks):
    rng = random.Random(7)
    words = ["".join(rng.choices("aBcé日", k=2)) for _ in range(40)]
    rows = []
    for i in range(300):
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", "S3", "é", None, "z"])
        text = " ".join(rng.choices(words[: rng.choice([8, 40])], k=rng.randrange(30)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), source))
    rows += [(900 + i, t, "odd", "s1") for i, t in enumerate(ODD)] + [(999, None, "alone", "x"), (1, rows[1][1], "en", "s2")] * 2
    got = divergence.source_divergence(
        docs_of(rows).repartition(4), least_documents=12, top_terms=6, groups_per_block=blocks[0], terms_per_block=blocks[1]
    )
    assert sorted(map(tuple, got.collect())) == plain_divergence([r[1:] for r in rows], 12, 6)


def test_divergence_without_kept_terms_and_without_rows(docs_of):
    got = divergence.source_divergence(docs_of([(1, "a", "en", "x"), (2, "b", "en", "y")]))
    assert sorted(map(tuple, got.collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence.source_divergence(docs_of([])).count() == 0
