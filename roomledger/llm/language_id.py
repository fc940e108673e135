"""Language identification by cross-parsing entropy.

Training keeps, per language, ``EXCERPTS`` excerpts of ``EXCERPT`` characters: one
document for each value of a hash of the id, cut out at a hashed place. A suffix
automaton of a language's excerpts answers how far a text can be read as a substring of
them. A document is cross-parsed by each automaton: every phrase is the longest match
from where the last one ended, and a letter without a match is a phrase of its own. The
phrases, normalised by log2 of the training length over the text length, estimate the
cross entropy; the language needing the least wins.

Letters count case-folded; all else separates words and is read as one blank. Texts are
cut into rows of ``WIDTH`` characters, all characters are read, and the automata walk
over thousands of rows at once; a phrase ends at the end of a row, for every language
alike.

Defined cases: null and empty texts and texts without a letter are ``und`` with score 0;
ties go to the language first in alphabetical order; rows without a language or text are
not learned from; if nothing can be learned, every row is ``und``; repeated rows are
predicted each; null ids are kept (and are not held out); other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import crc_of, ship, worker_cache
from roomledger.llm.tokens import strings

EXCERPTS = 64
EXCERPT = 600
WIDTH = 512
ROWS_AT_ONCE = 1500
LETTERS = 200
UNKNOWN = "und"
#: Phrases per character from which on a text is in none of the languages: its phrases are
#: not even two letters long. Letters that no training text holds reach 1, letters drawn at
#: random about 0.4, text of a learned language 0.2.
FOREIGN_RATE = 0.5
#: Letters and blanks up to which a rate says nothing: one phrase over two letters is 0.5.
SHORT = 16

PREDICTED = "doc_id long, lang_pred string, score double, rate double"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rate", pa.float64())]
)


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learned from; a null id is not held out."""
    return F.coalesce(F.pmod(crc_of(id_col), F.lit(3)) == 1, F.lit(False))


def excerpts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> tuple[tuple[str, str], ...]:
    """``(language, training text)``, at most ``EXCERPTS * EXCERPT`` characters each."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"),
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(EXCERPTS)).alias("place")
    # ids first: one long per language and place is all that is shuffled
    chosen = rows.groupBy("lang", place).agg(
        F.min_by("doc_id", F.xxhash64("doc_id", F.lit(11))).alias("doc_id")
    )
    ids = [r["doc_id"] for r in chosen.collect() if r["doc_id"] is not None]
    length = F.length("text")
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit(13)), F.greatest(length - EXCERPT, F.lit(1)))
    cut = F.substring("text", start.cast("int"), F.lit(EXCERPT))
    found = rows.where(F.col("doc_id").isin(ids)).select("lang", "doc_id", cut.alias("text"))
    by_language: dict[str, dict[int, str]] = {}
    for row in found.collect():
        by_language.setdefault(row["lang"], {})[row["doc_id"]] = row["text"]
    return tuple(
        (lang, "\n".join(texts[i] for i in sorted(texts))) for lang, texts in sorted(by_language.items())
    )


class Codes:
    """Letters as small numbers: 0 for all that separates words, 1 for learned letters beyond
    the ``LETTERS`` most frequent, which have numbers of their own, and the last number for
    letters that no training text holds.
    """

    def __init__(self, texts: list[str]) -> None:
        counts = Counter(c for t in texts for c in t.lower() if c.isalpha())
        self.letters = sorted(sorted(counts, key=lambda c: (-counts[c], c))[:LETTERS])
        self.unseen = len(self.letters) + 2
        self.size = self.unseen + 1
        top = max(map(ord, counts), default=0) + 1
        self.table = np.zeros(top, np.uint8)
        for c in range(top):
            self.table[c] = self.unseen if chr(c).isalpha() else 0
        for c in counts:
            self.table[ord(c)] = 1
        for code, c in enumerate(self.letters, 2):
            self.table[ord(c)] = code

    def __call__(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        top = len(self.table)
        codes = self.table[np.minimum(points, top - 1)]
        beyond = points >= top
        if beyond.any():
            codes[beyond] = [self.unseen if chr(p).isalpha() else 0 for p in points[beyond]]
        blank = codes == 0
        return codes[~(blank & np.concatenate(([True], blank[:-1])))] if len(codes) else codes


def automaton(codes: list[int], size: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``codes``: state x code -> state, or -1.

    State 0 is the start. The last link and length are only needed to build it.
    """
    most = 2 * len(codes) + 2
    step = np.full((most, size), -1, np.int32)
    link, length, last, states = [-1] * most, [0] * most, 0, 1
    for code in codes:
        now, states = states, states + 1
        length[now] = length[last] + 1
        at = last
        while at >= 0 and step[at, code] < 0:
            step[at, code] = now
            at = link[at]
        if at < 0:
            link[now] = 0
        else:
            other = int(step[at, code])
            if length[at] + 1 == length[other]:
                link[now] = other
            else:
                clone, states = states, states + 1
                length[clone] = length[at] + 1
                step[clone] = step[other]
                link[clone] = link[other]
                while at >= 0 and step[at, code] == other:
                    step[at, code] = clone
                    at = link[at]
                link[other] = link[now] = clone
        last = now
    return step[:states]


class CrossParser:
    """The automata of all languages in one table of transitions."""

    def __init__(self, training: tuple[tuple[str, str], ...]) -> None:
        self.languages = [lang for lang, _ in training]
        self.codes = Codes([text for _, text in training])
        self.logs, tables, self.roots = [], [], []
        states = 0
        for _, text in training:
            codes = self.codes(text)
            self.logs.append(math.log2(max(2, len(codes))))
            found = automaton(codes.tolist(), self.codes.size)
            tables.append(np.where(found >= 0, found + states, -1))
            self.roots.append(states)
            states += len(found)
        self.steps = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)

    def short(self, text: str) -> bool:
        """Too short to be judged by its phrases, and all its letters are learned ones."""
        codes = self.codes(text)
        return len(codes) <= SHORT and not (codes == self.codes.unseen).any()

    def phrases(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each row of codes (longest rows first) by each language."""
        size = self.codes.size
        roots = np.repeat(np.array(self.roots, np.int32)[:, None], len(rows), axis=1)
        state = roots.copy()
        count = np.zeros(roots.shape, np.int32)
        ends = len(rows) - np.searchsorted(lengths[::-1], np.arange(rows.shape[1]), "right")
        for at, n in enumerate(ends):
            if not n:
                break
            code = rows[:n, at].astype(np.int32)
            held = state[:, :n]
            after = self.steps[held * size + code]
            broken = after < 0
            # the phrase ends before this code, which begins the next one
            count[:, :n] += broken
            fresh = self.steps[roots[:, :n] * size + code]
            # a code that no training text holds is a phrase of its own
            alone = broken & (fresh < 0)
            count[:, :n] += alone & (held != roots[:, :n])
            after = np.where(broken, fresh, after)
            state[:, :n] = np.where(alone, roots[:, :n], after)
        count += state != roots
        return count

    def __call__(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """``(language, score, phrases per character)`` of each text."""
        coded = [self.codes(t) for t in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        letters = np.array([bool((c > 0).any()) for c in coded])
        cuts = -(-sizes // WIDTH)
        owner = np.repeat(np.arange(len(coded)), cuts)
        bits = np.zeros((len(self.languages), len(coded)))
        if len(owner) and self.languages:
            flat = np.concatenate([np.pad(c, (0, -len(c) % WIDTH)) for c in coded])
            rows = flat.reshape(-1, WIDTH)
            first = np.cumsum(cuts) - cuts
            lengths = np.minimum(WIDTH, sizes[owner] - (np.arange(len(owner)) - first[owner]) * WIDTH)
            order = np.argsort(-lengths, kind="stable")
            count = self.phrases(rows[order], lengths[order])
            for i, log in enumerate(self.logs):
                bits[i] = np.bincount(owner[order], count[i], len(coded)) * log / np.maximum(sizes, 1)
        found = []
        for i in range(len(coded)):
            if not letters[i] or not self.languages:
                found.append((UNKNOWN, 0.0, 0.0))
                continue
            each = bits[:, i]
            best = int(each.argmin())
            weights = np.exp2(each[best] - each)
            found.append((self.languages[best], float(1 / weights.sum()), float(each[best] / self.logs[best])))
        return found


@worker_cache
def _parser(training: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(training)


def _predict(training, batches):
    parser = _parser(training)
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(low, ROWS_AT_ONCE)
            texts = strings(pc.fill_null(part.column(1), ""))
            languages, scores, rates = zip(*parser(list(texts)))
            columns = [pa.array(languages), pa.array(scores), pa.array(rates)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=_ARROW)


def identify(
    docs: DataFrame,
    training: tuple[tuple[str, str], ...] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rate (phrases per character)."""
    ship(docs.sparkSession)
    if training is None:
        training = excerpts(docs, id_col, text_col, lang_col)
    read = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    found = read.mapInArrow(functools.partial(_predict, training), PREDICTED)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rate")


def _recognised(training, batches):
    parser = _parser(training)
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(low, ROWS_AT_ONCE)
            texts = strings(pc.fill_null(part.column("_lang_text"), ""))
            kept = [
                lang != UNKNOWN and (rate < FOREIGN_RATE or parser.short(text))
                for text, (lang, _, rate) in zip(texts, parser(list(texts)))
            ]
            yield part.drop_columns(["_lang_text"]).filter(pa.array(kept, pa.bool_()))


def recognised(
    docs: DataFrame,
    training: tuple[tuple[str, str], ...] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the learned languages, without a shuffle.

    Texts of up to ``SHORT`` letters and blanks stay if all their letters are learned.
    """
    ship(docs.sparkSession)
    if training is None:
        training = excerpts(docs, id_col, text_col, lang_col)
    read = docs.withColumn("_lang_text", F.col(text_col).cast("string"))
    return read.mapInArrow(functools.partial(_recognised, training), docs.schema)
