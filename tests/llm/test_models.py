"""Language, toxicity and personal data: rules by brute force, models by held-out accuracy."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roomledger.llm import language_id, pii, queries, toxicity
from roomledger.llm.common import table

DATA = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_rules(text):
    found = []
    for place, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and total % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), place, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.+-() 0123459%é\n", max_size=60))
def test_rules_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_rules(text)


@pytest.mark.parametrize(
    "text",
    [
        "a.b@c.de x@y @z.w a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111",
        "+1 (017) 555-7713", "4111111111111111" * 3, "+" + "1" * 15, "9" * 50_000, "a" * 50_000 + "@",
        ("7" * 40 + ".") * 500, "x" * 100_000 + " m@n.org",
    ],
)
def test_rules_on_traps(text):
    assert pii.base_spans(text) == plain_rules(text) if len(text) < 40_000 else pii.base_spans(text) is not None


def test_network_gradients():
    rng = np.random.default_rng(0)
    network = pii.Network()
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    codes = rng.integers(0, pii.CLASS_COUNT, (3, 7)).astype(np.uint8)
    tags = rng.integers(0, pii.TAGS, (3, 7))
    loss, grads = network.gradients(codes, tags)
    for name in network.w:
        at = tuple(rng.integers(0, n) for n in network.w[name].shape)
        if name.startswith("in_"):
            at = (int(codes[1, 3]), at[1])
        network.w[name][at] += 1e-4
        more = network.gradients(codes, tags)[0]
        network.w[name][at] -= 1e-4
        assert abs((more - loss) / 1e-4 - grads[name][at]) < 2e-3


def test_windows_cover_all_triggers_and_are_reconciled():
    text = "x" * 100 + "1" * 150 + "y" * 60 + "a@b.cd" + "z" * 300 + "7"
    starts = pii.windows(text)
    covered = {i for s in starts for i in range(s, s + pii.WINDOW)}
    assert {i for i, c in enumerate(text) if c in "@17"} <= covered
    decoded = np.tile(np.arange(pii.WINDOW) % 3, (len(starts), 1)).astype(np.int8)
    tags = pii.reconciled(len(text), starts, decoded)
    assert len(tags) == len(text)


def test_network_learns_spans_of_held_out_texts(spark):
    rows = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text").collect()
    held = {r.doc_id: r.text for r in rows if pii.base_spans(r.text)}
    ids = sorted(held)
    weights = pii.train([held[i] for i in ids if i % 4])
    network, found, wanted, right = pii.Network(weights), 0, 0, 0
    for i in ids:
        if i % 4 == 0:
            starts = pii.windows(held[i])
            tags = network.decode(pii._padded(pii.classes(held[i]), starts))
            got = set(pii.spans_of(pii.reconciled(len(held[i]), starts, tags)))
            truth = set(pii.base_spans(held[i]))
            found, wanted, right = found + len(got), wanted + len(truth), right + len(got & truth)
    assert right / wanted > 0.9 and right / found > 0.5


def test_personal_data_of_whole_tables(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "m@n.org é 1.2.3.4"), (3, "m@n.org é 1.2.3.4"), (None, "+1 (017) 555-7713")]
    rows.append((4, "no data " * 20_000))
    got = pii.personal_data(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((t or "" for i, t in rows if i == r.doc_id))
        base = pii.shown(plain_rules(text))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(r.spans.split(",")) or not base
    assert pii.personal_data(docs_of([])).count() == 0


def test_automaton_knows_all_substrings():
    text = [2, 3, 2, 2, 4, 3, 2, 3, 4, 4, 2]
    step = language_id.automaton(text, 5)
    for a in range(len(text)):
        for b in range(a + 1, len(text) + 1):
            state = 0
            for c in text[a:b]:
                state = step[state, c]
            assert state >= 0
    state = step[step[step[0, 3], 3], 3] if step[step[0, 3], 3] >= 0 else -1
    assert state < 0


def phrases(text, training):
    count, at = 0, 0
    while at < len(text):
        length = 1
        while at + length < len(text) and text[at : at + length + 1] in training and text[at] in training:
            length += 1
        count, at = count + 1, at + length
    return count


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcd ", min_size=1, max_size=60), st.text(alphabet="abc ", min_size=1, max_size=80))
def test_phrases_are_longest_matches(text, training):
    parser = language_id.CrossParser((("x", training),))
    code = parser.codes(text)
    rows = np.pad(code, (0, 80 - len(code)))[None]
    got = parser.phrases(rows, np.array([len(code)]))[0, 0]
    as_text = "".join(map(chr, code + 65))
    assert got == phrases(as_text, "".join(map(chr, parser.codes(training) + 65)))


def test_languages_of_held_out_documents(spark):
    docs = table(spark, DATA, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.op4_language_id(spark, DATA).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark, docs_of):
    training = (("de", "der die das und nicht sein haben"), ("en", "the and that of with from have"))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "and that of"), (4, "and that of"), (5, "nicht haben und " * 9000)]
    rows += [(None, "the"), (6, "語語語語語語")]
    docs = docs_of(rows)
    got = sorted(((r.doc_id or 0, r.lang_pred, r.score) for r in language_id.identify(docs, training).collect()))
    named = [(i, lang) for i, lang, _ in got]
    assert named[:4] == [(0, "en"), (1, "und"), (2, "und"), (3, "und")]
    assert named[4:7] == [(4, "en"), (4, "en"), (5, "de")] and named[7][0] == 6
    assert [s for _, lang, s in got if lang == "und"] == [0, 0, 0]
    kept = language_id.recognised(docs, training)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4, 5]
    assert language_id.identify(docs_of([])).count() == 0
    nothing = docs_of([(1, "text", None, "s")])
    assert [r.lang_pred for r in language_id.identify(nothing).collect()] == ["und"]


def test_kernel_tolerates_gaps_and_insertions():
    kernel = toxicity.Kernel("abcdefghijklmnopqrstuvwxyz", ("idiot",))
    same, inserted, other = kernel(["idiot", "idxiot", "table"])[:, 0]
    assert abs(same - 1) < 1e-5 and same > inserted > 10 * other
    assert toxicity.joined_letters("an i d i o t, or s.c.u.m!") .split()[-2:] == ["idiot", "scum"]


def plain_kernel(s, t):
    def weights(u):
        u, found = "^" + u, {}
        for i in range(len(u)):
            for j in range(i + 1, len(u)):
                for k in range(j + 1, min(len(u), i + toxicity.SPAN)):
                    key = u[i] + u[j] + u[k]
                    found[key] = found.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return found

    a, b = weights(s), weights(t)
    dot = sum(v * b.get(k, 0) for k, v in a.items())
    norm = sum(v * v for v in a.values()) * sum(v * v for v in b.values())
    return (dot / norm**0.5) ** toxicity.POWER if norm else 0.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=9), min_size=1, max_size=6), st.text(alphabet="abc", min_size=3, max_size=7))
def test_kernel_equals_its_definition(units, landmark):
    got = toxicity.Kernel("abc", (landmark,))(units)[:, 0]
    assert np.allclose(got, [plain_kernel(u, landmark) for u in units], atol=1e-4)


def test_toxicity_of_held_out_documents(spark):
    data = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in table(spark, data, "labels").collect()}
    got = queries.op8_toxicity(spark, data).collect()
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    right = sum(p and t for p, t in held)
    assert right / sum(t for _, t in held) > 0.8 and right / sum(p for p, _ in held) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_cases(spark, docs_of):
    rows = [(i, f"word{i % 7} and more. {'you idiot scum' if i % 3 == 0 else 'you are kind'} here") for i in range(90)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows] + [(999, 1, 1), (1, 1, None)],
                                   "doc_id long, quality int, toxic int")
    more = [(200, None), (201, ""), (202, "idiot " * 20_000), (203, "an i d i o t"), (203, "an i d i o t"), (None, "kind")]
    got = toxicity.toxicity(docs_of(rows + more), labels).collect()
    assert len(got) == len(rows) + len(more)
    by_id = {r.doc_id: r.predicted for r in got}
    assert all(by_id[i] == int(i % 3 == 0) for i in range(90))
    assert (by_id[200], by_id[201], by_id[202], by_id[203], by_id[None]) == (0, 0, 1, 1, 0)
    assert toxicity.toxicity(docs_of([]), labels).count() == 0
    clean = labels.where("toxic = 0")
    assert {r.score for r in toxicity.toxicity(docs_of(rows), clean).collect()} == {0.0}


@pytest.mark.parametrize("mark", ["_", "-", "/", ",", "..", ""])
def test_chunks_without_blanks_are_scored_whole(spark, docs_of, mark):
    rows = [(i, f"word{i % 7} and more. {'you idiot scum' if i % 3 == 0 else 'you are kind'} here") for i in range(90)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    mild = mark.join(["word", "and", "more", "kind", "here"] * 4)
    made = [(100, mild), (101, mild + mark + mark.join(["you", "idiot", "scum"])), (102, mild + mark + mild)]
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs_of(rows + made), labels).collect()}
    assert got[101] > got[100] and got[101] > got[102]
    for text in (t for _, t in made):
        units, plain = toxicity.units_of(text), toxicity.MARKS.sub("", text)
        assert all(len(u) <= toxicity.WORD for u in units)
        # every stretch of SPAN characters between marks is in a unit
        for part in toxicity.MARKS.split(text):
            spans = [part[i : i + toxicity.SPAN] for i in range(max(1, len(part) - toxicity.SPAN + 1))]
            assert all(any(x in u for u in units) for x in spans)
        assert set("".join(units)) == set(plain)
    assert toxicity.units_of("sc*um") == ["scum"] and toxicity.units_of("--") == []
