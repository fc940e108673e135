"""What the language stage keeps: short texts, large alphabets, and what goes beside them."""

from __future__ import annotations

import random

from roomledger.llm import common, language_id

ENGLISH = "the quick brown fox jumps over the lazy dog and runs back to its den before the rain begins "


def learned(rng):
    script = [chr(0x4E00 + i) for i in range(3000)]
    return (("en", ENGLISH * 40), ("zz", "".join(rng.choices(script, k=38_000)))), script


def test_short_and_foreign_texts(docs_of):
    rng = random.Random(3)
    training, script = learned(rng)
    stay = ["A.", "Hi", "Ok", "no", "  go ", "1. The", "the fox runs back to its den", ENGLISH * 3,
            "".join(rng.choices(script, k=12)), training[1][1][500:700]]
    # no letters, letters that nobody taught, and a mixture that is mostly such
    go = [None, "", "12.5 !", "Привет, как дела сегодня", "안녕하세요 세계 여러분", "Ж", "сто " * 300, "한국어 " * 300, "ok Ж ы ф"]
    rows = [(i, t) for i, t in enumerate(stay)] + [(100 + i, t) for i, t in enumerate(go)]
    kept = language_id.recognised(docs_of(rows), training)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(len(stay)))
    assert kept.columns == docs_of(rows).columns


def test_unlearned_letters_are_phrases_of_their_own():
    rng = random.Random(4)
    training, script = learned(rng)
    parser = language_id.CrossParser(training)
    for text in ("Привет", "안녕하세요", "сто лет"):
        letters = sum(c.isalpha() for c in text)
        language, _, rate = parser([text])[0]
        assert rate >= letters / (letters + text.count(" ")) - 1e-9
    assert parser(["".join(script[:50])])[0][0] == "zz"


def test_a_worker_holds_the_last_cache_only():
    built = []

    @common.worker_cache
    def one(key):
        built.append(("one", key))
        return [key]

    @common.worker_cache
    def other(key):
        built.append(("other", key))
        return [key]

    first = one(1)
    assert one(1) is first and other(1) == [1] and one(2) == [2] and one(1) == [1]
    assert built == [("one", 1), ("other", 1), ("one", 2), ("one", 1)]
