"""Toxicity by a subsequence string kernel machine with Nyström landmarks.

Units are case-folded words without marks, with a begin sign, and runs of single letters
(``i d i o t``) joined. What has no blank for more than ``WORD`` characters is broken up at
its marks and into overlapping stretches; all of it is scored. The kernel of two units compares their subsequences of three
characters, weighted by ``DECAY`` per character of their span (up to ``SPAN``), so
inserted characters and gaps lower it gradually; it is normalised and raised to ``POWER``.

Training rows give labelled sentences. ``LANDMARKS`` units, those most typical of toxic
documents and the most frequent others, span the Nyström space; a sentence is the mean of
its units there; a linear machine with squared hinge loss is fitted by Newton steps.
Being linear, it scores units, and each distinct unit is scored once per worker. A
document's score is a logistic function of the sum and the density of its units' scores,
fitted on the training documents.

Training reads at most ``SAMPLE`` documents of each label, of at most ``LONGEST``
characters each: one per hash value of the id, so any labelled row may be chosen.

Defined cases: null and empty texts have no units and get the score of a text without
toxic units; labels that are null or of unknown documents are not learned from; with
only one label in the training rows every score is that label's share; repeated rows
are scored each; null ids are kept; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import crc_of, documents
from roomledger.llm.tokens import strings

SAMPLE = 800
LONGEST = 8000
LANDMARKS = 96
DECAY = 0.6
SPAN = 6
POWER = 3
#: At most so many typical landmarks are that similar to one another.
OF_A_KIND, ALIKE = 4, 0.6
LIMIT = 1_000_000
ROWS_AT_ONCE = 1500
ALPHABET = 64
#: Longer chunks are broken up, into stretches of a usual word that overlap by ``SPAN``:
#: wider ones hide a word among its neighbours.
WORD, STRETCH, STEP = 40, 10, 4

MARKS = re.compile(r"[\W_]+")
SPELLED = re.compile(r"(?<!\w)\w(?:[ .*_-]{1,2}\w(?!\w)){2,}")
SENTENCE = re.compile(r"[.!?\n]+\s")

SCORED = "doc_id long, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(crc_of(id_col), F.lit(5)) == 0, F.lit(False))


def joined_letters(text: str) -> str:
    """The text, followed by its spelled-out words in one piece."""
    found = [MARKS.sub("", m) for m in SPELLED.findall(text)]
    return f"{text} {' '.join(found)}" if found else text


def units_of(chunk: str) -> list[str]:
    """The chunk without marks as one unit, if it is of a word's length. Otherwise its
    parts between marks, parts of one or two letters joined with such neighbours, and
    long parts as overlapping stretches, so that every character is in a unit."""
    whole = MARKS.sub("", chunk)
    if len(whole) <= WORD:
        return [whole] if whole else []
    parts: list[str] = []
    joined = False  # whether the last part may grow
    for part in MARKS.split(chunk):
        if not part:
            continue
        short = len(part) <= 2
        if short and joined and len(parts[-1]) + len(part) <= WORD:
            parts[-1] += part
        else:
            parts.append(part)
        joined = short
    units = []
    for part in parts:
        if len(part) <= WORD:
            units.append(part)
        else:
            last = len(part) - STRETCH
            units += [part[min(i, last) :][:STRETCH] for i in range(0, last + STEP, STEP)]
    return units


class Triples:
    """Weighted subsequences of three characters of many units at once."""

    def __init__(self, letters: str) -> None:
        # rare letters share the last code
        self.codes = {c: i for i, c in enumerate("^" + letters[: ALPHABET - 2])}

    def __call__(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(unit, triple, weight)`` with each triple of a unit once, sorted."""
        rest, codes = ALPHABET - 1, self.codes
        text = np.array([codes.get(c, rest) for u in units for c in "^" + u], np.int64)
        sizes = np.array([len(u) + 1 for u in units], np.int64)
        owner = np.repeat(np.arange(len(units)), sizes)
        keys, weights = [], []
        for second in range(1, SPAN - 1):
            for third in range(second + 1, SPAN):
                n = len(text) - third
                if n <= 0:
                    continue
                same = np.flatnonzero(owner[:n] == owner[third:])
                triple = (text[same] * ALPHABET + text[same + second]) * ALPHABET + text[same + third]
                keys.append(owner[same] * ALPHABET**3 + triple)
                weights.append(np.full(len(same), DECAY ** (third + 1)))
        if not keys:
            empty = np.zeros(0, np.int64)
            return empty, empty, np.zeros(0)
        key, weight = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else []
        if not len(key):
            return key, key, weight
        key, weight = key[starts], np.add.reduceat(weight, starts)
        return key // ALPHABET**3, key % ALPHABET**3, weight


@dataclass(frozen=True)
class Model:
    letters: str
    landmarks: tuple[str, ...]
    weights: tuple[float, ...]  # of the kernels with the landmarks
    bias: float
    logistic: tuple[float, ...]  # constant, sum, density
    constant: float | None = None


class Kernel:
    """Normalised kernels of units with the landmarks."""

    def __init__(self, letters: str, landmarks: tuple[str, ...]) -> None:
        self.triples, self.count = Triples(letters), len(landmarks)
        unit, triple, weight = self.triples(list(landmarks))
        norms = np.sqrt(np.bincount(unit, weight**2, len(landmarks)))
        known = np.unique(triple)
        self.place = np.zeros(ALPHABET**3, np.int32)
        self.place[known] = np.arange(1, len(known) + 1)
        self.table = np.zeros((len(known) + 1, len(landmarks)), np.float32)
        self.table[self.place[triple], unit] = weight / np.maximum(norms, 1e-12)[unit]

    def __call__(self, units: list[str]) -> np.ndarray:
        found = np.zeros((len(units), self.count), np.float32)
        for low in range(0, len(units), 8192):
            part = units[low : low + 8192]
            unit, triple, weight = self.triples(part)
            norms = np.sqrt(np.bincount(unit, weight**2, len(part)))
            at = self.place[triple]
            shared = at > 0
            unit, at, weight = unit[shared], at[shared], weight[shared].astype(np.float32)
            if len(unit):
                starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
                sums = np.add.reduceat(self.table[at] * weight[:, None], starts, axis=0)
                found[low + unit[starts]] = sums / np.maximum(norms[unit[starts], None], 1e-12)
        return found**POWER


def training_rows(docs, labels, id_col="doc_id", text_col="text", label_col="toxic") -> list[tuple[str, int]]:
    """``(text, label)`` of the bounded sample, in the order of ids."""
    known = labels.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")
    ).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SAMPLE)).alias("place")
    chosen = known.groupBy("label", place).agg(F.min_by("doc_id", F.xxhash64("doc_id")).alias("doc_id"))
    by_id = {r["doc_id"]: r["label"] for r in chosen.collect()}
    texts = documents(docs, id_col, text_col).where(
        F.col("doc_id").isin(list(by_id)) & (F.length("text") <= LONGEST)
    )
    found = {r["doc_id"]: r["text"] for r in texts.collect()}
    return [(found[i], by_id[i]) for i in sorted(found)]


def _landmarks(rows: list[tuple[list[str], int]], letters: str) -> tuple[str, ...]:
    """Units typical of toxic documents, few of a kind, then frequent ones. Copies count once."""
    seen: set[tuple] = set()
    counts = (Counter(), Counter())
    sizes = [0, 0]
    for units, label in rows:
        mark = tuple(units[:20])
        if mark not in seen:
            seen.add(mark)
            sizes[label] += 1
            counts[label].update(set(units))

    def odds(u: str) -> float:
        toxic = (counts[1][u] + 0.5) / (sizes[1] + 1)
        clean = (counts[0][u] + 0.5) / (sizes[0] + 1)
        return np.log(toxic / clean) * np.sqrt(counts[1][u])

    frequent = [u for u, n in counts[1].items() if n >= 3 and len(u) > 2]
    ranked = sorted(frequent, key=lambda u: (-odds(u), u))[: 8 * LANDMARKS]
    alike = Kernel(letters, tuple(ranked))(ranked) > ALIKE**POWER
    chosen: list[int] = []
    for i in range(len(ranked)):
        if len(chosen) < 2 * LANDMARKS // 3 and alike[i, chosen].sum() < OF_A_KIND:
            chosen.append(i)
    typical = [ranked[i] for i in chosen]
    common = sorted(counts[0], key=lambda u: (-counts[0][u], u))
    rest = [u for u in common if u not in set(typical) and len(u) > 1]
    return tuple(typical + rest[: LANDMARKS - len(typical)])


def _units(text: str) -> list[str]:
    return [u for c in joined_letters(text.lower()).split() for u in units_of(c)]


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the primal; the last column of ``x`` is constant."""
    w = np.zeros(x.shape[1])
    eye = ridge * np.eye(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        held = x[active] * cost[active, None]
        new = np.linalg.solve(held.T @ x[active] + eye, held.T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _features(scores: np.ndarray) -> tuple[float, float, float]:
    total = float(np.maximum(scores, 0).sum())
    return 1.0, np.log1p(10 * total), np.log1p(1000 * total / max(50, len(scores)))


def train(rows: list[tuple[str, int]]) -> Model:
    """Fits a model to ``(text, label)``."""
    labels = np.array([label for _, label in rows])
    if len(set(labels.tolist())) < 2:
        return Model("", (), (), 0.0, (), float(labels.mean()) if len(labels) else 0.0)
    held = [(_units(text), label) for text, label in rows]
    letters = Counter(c for units, _ in held for u in units for c in u)
    letters = "".join(sorted(letters, key=lambda c: (-letters[c], c)))
    landmarks = _landmarks(held, letters)
    kernel = Kernel(letters, landmarks)
    values, vectors = np.linalg.eigh(kernel(list(landmarks)).astype(float))
    good = values > 1e-6
    to_space = vectors[:, good] / np.sqrt(values[good])
    vocabulary = sorted({u for units, _ in held for u in units})
    index = {u: i for i, u in enumerate(vocabulary)}
    # the kernels themselves are kept for a stretch of units at a time
    to_space = to_space.astype(np.float32)
    parts = [kernel(vocabulary[i : i + 8192]) @ to_space for i in range(0, len(vocabulary), 8192)]
    space = np.concatenate(parts)
    del parts
    x, y, cost = [], [], []
    for text, label in rows:
        sentences = [s for s in (_units(p) for p in SENTENCE.split(text)) if s]
        for units in sentences:
            x.append(space[[index[u] for u in units if u in index]].mean(axis=0))
            y.append(2 * label - 1)
            cost.append(1 / len(sentences))
    x = np.nan_to_num(np.array(x, np.float32))
    x = np.hstack([10 * x, np.ones((len(x), 1), np.float32)])
    w = _squared_hinge(x, np.array(y, float), np.array(cost))
    weights = to_space @ (10 * w[:-1])
    unit_scores = space @ (10 * w[:-1])
    # the sentence machine's zero, for a unit: what hardly any unit of a clean text reaches
    clean = np.concatenate([unit_scores[[index[u] for u in units]] for units, label in held if not label and units])
    bias = float(np.quantile(clean, 0.995))
    scale = max(1e-9, float(unit_scores.max()) - bias)
    scores = (unit_scores - bias) / scale
    features = np.array([_features(scores[[index[u] for u in units]]) for units, _ in held])
    logistic = _logistic(features, labels)
    return Model(letters, landmarks, tuple(weights / scale), bias / scale, tuple(logistic))


class Scorer:
    """Scores texts, and each distinct unit once while it is held."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.kernel = Kernel(model.letters, model.landmarks) if model.landmarks else None
        self.weights = np.array(model.weights, np.float32)
        self.known: dict[str, float] = {}

    def units(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the units of case-folded chunks, and each chunk's number of units."""
        if len(self.known) > LIMIT:
            self.known = {}
        found = [units_of(c) for c in chunks]
        new = list({u for units in found for u in units if u not in self.known})
        if new:
            self.known.update(zip(new, (self.kernel(new) @ self.weights - self.model.bias).tolist()))
        scores = np.array([self.known[u] for units in found for u in units], float)
        return scores, np.array([len(units) for units in found], np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(texts), self.model.constant)
        words = pc.utf8_split_whitespace(pa.array([joined_letters(t.lower()) for t in texts], pa.string()))
        coded = words.values.dictionary_encode()
        scores, sizes = self.units(strings(coded.dictionary))
        chunks = coded.indices.to_numpy()
        each, firsts = sizes[chunks], (np.cumsum(sizes) - sizes)[chunks]
        upto = np.concatenate(([0], np.cumsum(each)))
        # the units of all chunks, one after the other
        scores = scores[np.repeat(firsts - upto[:-1], each) + np.arange(upto[-1])]
        ends = upto[words.offsets.to_numpy()]
        rows = []
        for a, b in zip(ends[:-1], ends[1:]):
            rows.append(_features(scores[a:b]))
        z = np.array(rows).reshape(-1, 3) @ np.array(self.model.logistic)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@functools.lru_cache(maxsize=1)
def _scorer(model: Model) -> Scorer:
    return Scorer(model)


def _score(model: Model, batches):
    scorer = _scorer(model)
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(low, ROWS_AT_ONCE)
            scores = scorer(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], schema=_ARROW)


def toxicity(
    docs: DataFrame,
    labels: DataFrame | None = None,
    model: Model | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    if model is None:
        model = train(training_rows(docs, labels, id_col, text_col, label_col))
    found = documents(docs, id_col, text_col).mapInArrow(functools.partial(_score, model), SCORED)
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )
