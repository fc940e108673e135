"""Personal data: rules for four kinds, and a character BiLSTM with CRF transitions on top.

The rules give the base spans, which always stay. They also label the training windows:
the network learns, from a bounded sample of documents, what surrounds and makes up such
spans, and adds spans that the rules reject or cannot express. A number needs a digit and
an address an at sign, so only stretches around these characters are read by the network:
they are cut into overlapping windows of ``WINDOW`` characters, each window is decoded by
Viterbi, and where windows overlap a character takes the tag of the window in whose
middle it lies most. The tags of a document are then read as spans from left to right;
added spans that touch a base span or are too short for their kind are left out.

The rules are written as single passes: long runs of digits or letters cost linear time.

Defined cases: null text is empty; a text without at signs and digits has no spans;
offsets are code points, ends exclusive; equal starts are ordered as the kinds are
listed; repeated rows are searched each; null ids are kept; if the sample holds no spans,
nothing is added; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import documents
from roomledger.llm.tokens import strings

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Every number of a kind lies in such a run, which is cut nowhere.
NUMBERS = re.compile(r"[0-9+][\x20.()0-9+-]{6,}")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: Where the network looks.
TRIGGER = re.compile(r"[@0-9]+")

WINDOW, STRIDE, MARGIN = 64, 32, 24
HIDDEN = 16
SAMPLE = 1024
LONGEST = 20_000
TRAINING_WINDOWS = 3000
STEPS, BATCH, RATE = 400, 32, 0.02
ROWS_AT_ONCE = 2000
WINDOWS_AT_ONCE = 4096

#: Classes of characters: the input of the network.
CLASSES = "\x00@.+-()_% \n\t,:;|/\"'=#"
CLASS_COUNT = len(CLASSES) + 5  # digits, lower case, upper case, other letters, the rest
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append(("email", start, free))
        at = text.find("@", max(at + 1, free))
    return found


def _ips(run: str, at: int) -> list[Span]:
    found = []
    for dotted in DOTTED.finditer(run):
        parts = dotted.group().split(".")
        start = at + dotted.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                found.append(("ip", start, start + length))
            start += length + 1
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the rules, by start and kind."""
    found = _emails(text) if "@" in text else []
    for run in NUMBERS.finditer(text):
        held, at = run.group(), run.start()
        found += _ips(held, at)
        for m in CARD.finditer(held):
            digits = NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", at + m.start(), at + m.end()))
        for m in PHONE.finditer(held):
            if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                found.append(("phone", at + m.start(), at + m.end()))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return _CLASS_TABLE[np.minimum(points, len(_CLASS_TABLE) - 1)]


def _class_table() -> np.ndarray:
    digit = len(CLASSES)
    table = np.full(0x250, digit + 4, np.uint8)
    for point in range(len(table) - 1):
        c = chr(point)
        if c in CLASSES:
            table[point] = CLASSES.index(c)
        elif "0" <= c <= "9":
            table[point] = digit
        elif c.isalpha():
            table[point] = digit + (1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3)
    return table


_CLASS_TABLE = _class_table()


def windows(text: str) -> list[int]:
    """Starts of the windows over all stretches that hold an at sign or a digit."""
    starts: list[int] = []
    low = high = -1
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if a > high:
            starts += _cut(low, high)
            low = a
        high = b
    return starts + _cut(low, high)


def _cut(low: int, high: int) -> list[int]:
    if low < 0:
        return []
    return list(range(low, max(low + 1, high - (WINDOW - STRIDE)), STRIDE))


def _padded(codes: np.ndarray, starts: list[int]) -> np.ndarray:
    """Rows of class codes; code 0 stands beyond the ends of the text."""
    held = np.concatenate((codes, np.zeros(WINDOW, np.uint8)))
    return held[np.array(starts)[:, None] + np.arange(WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two LSTMs over class codes, emissions from both, and a linear chain on the tags."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 3) -> None:
        if weights is None:
            rng = np.random.default_rng(seed)

            def small(*shape):
                return (rng.standard_normal(shape) * 0.2).astype(np.float32)

            weights = {"out": small(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32)}
            weights["chain"] = np.zeros((TAGS + 1, TAGS), np.float32)  # last row: the first tag
            for way in "fb":
                weights[f"in_{way}"] = small(CLASS_COUNT, 4 * HIDDEN)
                weights[f"re_{way}"] = small(HIDDEN, 4 * HIDDEN)
                weights[f"in_{way}"][:, HIDDEN : 2 * HIDDEN] += 1  # remember at first
        self.w = weights

    def _run(self, codes: np.ndarray, way: str, keep: bool):
        n, length = codes.shape
        into, again = self.w[f"in_{way}"], self.w[f"re_{way}"]
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, length, HIDDEN), np.float32)
        kept = []
        for t in range(length) if way == "f" else range(length - 1, -1, -1):
            z = into[codes[:, t]] + h @ again
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before = c
            c = f * c + i * g
            top = np.tanh(c)
            if keep:
                kept.append((t, i, f, o, g, before, top, h))
            h = o * top
            out[:, t] = h
        return out, kept

    def emissions(self, codes: np.ndarray, keep: bool = False):
        forth, kept_f = self._run(codes, "f", keep)
        back, kept_b = self._run(codes, "b", keep)
        both = np.concatenate((forth, back), axis=2)
        return both @ self.w["out"] + self.w["bias"], both, kept_f, kept_b

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tags of each row."""
        scores = self.emissions(codes)[0]
        chain = self.w["chain"]
        n, length, _ = scores.shape
        best = scores[:, 0] + chain[TAGS]
        back = np.zeros((n, length, TAGS), np.int8)
        for t in range(1, length):
            every = best[:, :, None] + chain[None, :TAGS]
            back[:, t] = every.argmax(axis=1)
            best = every.max(axis=1) + scores[:, t]
        tags = np.zeros((n, length), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood per row and its gradients."""
        scores, both, kept_f, kept_b = self.emissions(codes, keep=True)
        chain, rows = self.w["chain"], np.arange(len(codes))
        n, length, _ = scores.shape
        alpha = np.zeros_like(scores, np.float64)
        beta = np.zeros_like(scores, np.float64)
        alpha[:, 0] = scores[:, 0] + chain[TAGS]
        for t in range(1, length):
            alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + chain[None, :TAGS], 1) + scores[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = _log_sum(chain[None, :TAGS] + (scores[:, t + 1] + beta[:, t + 1])[:, None], 2)
        total = _log_sum(alpha[:, -1], 1)
        d_scores = np.exp(alpha + beta - total[:, None, None])
        d_chain = np.zeros_like(chain, np.float64)
        d_chain[TAGS] += d_scores[:, 0].sum(axis=0)
        np.add.at(d_chain, (TAGS, tags[:, 0]), -1)
        gold = scores[rows, 0, tags[:, 0]] + chain[TAGS, tags[:, 0]]
        for t in range(1, length):
            pair = alpha[:, t - 1, :, None] + chain[None, :TAGS] + (scores[:, t] + beta[:, t])[:, None]
            d_chain[:TAGS] += np.exp(pair - total[:, None, None]).sum(axis=0)
            np.add.at(d_chain, (tags[:, t - 1], tags[:, t]), -1)
            gold += scores[rows, t, tags[:, t]] + chain[tags[:, t - 1], tags[:, t]]
        d_scores[rows[:, None], np.arange(length)[None], tags] -= 1
        d_scores = (d_scores / n).astype(np.float32)
        grads = {"chain": (d_chain / n).astype(np.float32), "bias": d_scores.sum(axis=(0, 1))}
        grads["out"] = both.reshape(-1, 2 * HIDDEN).T @ d_scores.reshape(-1, TAGS)
        d_both = d_scores @ self.w["out"].T
        self._back(codes, "f", kept_f, d_both[:, :, :HIDDEN], grads)
        self._back(codes, "b", kept_b, d_both[:, :, HIDDEN:], grads)
        return float((total - gold).mean()), grads

    def _back(self, codes, way, kept, d_out, grads) -> None:
        again = self.w[f"re_{way}"]
        d_in, d_re = np.zeros_like(self.w[f"in_{way}"]), np.zeros_like(again)
        d_h = np.zeros((len(codes), HIDDEN), np.float32)
        d_c = np.zeros_like(d_h)
        for t, i, f, o, g, before, top, h in reversed(kept):
            d_h = d_h + d_out[:, t]
            d_c = d_c + d_h * o * (1 - top * top)
            d_z = np.concatenate(
                (
                    d_c * g * i * (1 - i),
                    d_c * before * f * (1 - f),
                    d_h * top * o * (1 - o),
                    d_c * i * (1 - g * g),
                ),
                axis=1,
            )
            np.add.at(d_in, codes[:, t], d_z)
            d_re += h.T @ d_z
            d_h, d_c = d_z @ again.T, d_c * f
        grads[f"in_{way}"], grads[f"re_{way}"] = d_in, d_re


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def tags_of(spans: list[Span], length: int) -> np.ndarray:
    tags = np.zeros(length + WINDOW, np.int64)
    for kind, a, b in spans:
        tags[a] = 1 + 2 * KINDS.index(kind)
        tags[a + 1 : b] = 2 + 2 * KINDS.index(kind)
    return tags


def training_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of at most ``TRAINING_WINDOWS`` windows, every kind alike where it can."""
    pools: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for text in texts:
        starts = windows(text)
        if not starts:
            continue
        tags = tags_of(base_spans(text), len(text))
        for start, row in zip(starts, _padded(classes(text), starts)):
            held = tags[start : start + WINDOW]
            pools.setdefault(int(held.max()), []).append((row, held))
    each = max(1, TRAINING_WINDOWS // max(1, len(pools)))
    rng = np.random.default_rng(5)
    chosen = []
    for kind in sorted(pools):
        order = rng.permutation(len(pools[kind]))[:each]
        chosen += [pools[kind][i] for i in order]
    if not chosen:
        return np.zeros((0, WINDOW), np.uint8), np.zeros((0, WINDOW), np.int64)
    return np.array([c for c, _ in chosen]), np.array([t for _, t in chosen])


def train(texts: list[str], steps: int = STEPS) -> dict[str, np.ndarray] | None:
    """Weights fitted with Adam to the windows of ``texts``; None where they hold no span."""
    codes, tags = training_windows(texts)
    if not tags.any():
        return None
    network = Network()
    first = {k: np.zeros_like(v) for k, v in network.w.items()}
    second = {k: np.zeros_like(v) for k, v in network.w.items()}
    rng, order = np.random.default_rng(7), np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < min(BATCH, len(codes)):
            order = rng.permutation(len(codes))
        part, order = order[:BATCH], order[BATCH:]
        _, grads = network.gradients(codes[part], tags[part])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        # the last third goes in small steps
        rate = RATE * (0.25 if step > 2 * steps // 3 else 1.0)
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            lean = first[k] / (1 - 0.9**step)
            network.w[k] = network.w[k] - rate * lean / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return network.w


def reconciled(length: int, starts: list[int], decoded: np.ndarray) -> np.ndarray:
    """One tag per character: that of the window in whose middle it lies most."""
    tags = np.zeros(length + WINDOW, np.int8)
    depth = np.full(length + WINDOW, -1, np.int16)
    inner = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.int16)
    for start, row in zip(starts, decoded):
        # the first window of a text has nothing cut off before it
        own = np.arange(WINDOW, 0, -1, dtype=np.int16) if start == 0 else inner
        here = slice(start, start + WINDOW)
        better = own > depth[here]
        tags[here][better] = row[better]
        depth[here][better] = own[better]
    return tags[:length]


def spans_of(tags: np.ndarray) -> list[Span]:
    """Spans of a tag sequence; an inside tag that continues nothing begins a span."""
    found: list[Span] = []
    kind, start = 0, 0
    places = np.flatnonzero(tags)
    last = -2
    for at in places.tolist():
        tag = int(tags[at])
        now, begins = (tag + 1) // 2, tag % 2 == 1
        if kind and (at != last + 1 or now != kind or begins):
            found.append((KINDS[kind - 1], start, last + 1))
            kind = 0
        if not kind:
            kind, start = now, at
        last = at
    if kind:
        found.append((KINDS[kind - 1], start, last + 1))
    return found


def plausible(span: Span, text: str) -> bool:
    """Whether an added span has what its kind cannot do without."""
    kind, a, b = span
    held = text[a:b]
    digits = len(NOT_DIGIT.sub("", held))
    if kind == "email":
        return 0 < held.find("@") and "." in held[held.find("@") :]
    if kind == "ip":
        return held.count(".") == 3 and digits >= 4 and not any(len(p) > 3 for p in held.split("."))
    return 14 <= digits <= 19 if kind == "card" else 10 <= digits <= 15 and held[0] in "+0("


def found_in(texts: list[str], network: Network | None) -> list[tuple[list[Span], list[Span]]]:
    """``(base spans, all spans)`` of each text."""
    base = [base_spans(t) for t in texts]
    if network is None:
        return [(b, b) for b in base]
    starts = [windows(t) for t in texts]
    rows = [_padded(classes(t), s) for t, s in zip(texts, starts) if s]
    decoded = []
    if rows:
        # equal windows, as in copies, are decoded once
        distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        tags = [
            network.decode(distinct[i : i + WINDOWS_AT_ONCE])
            for i in range(0, len(distinct), WINDOWS_AT_ONCE)
        ]
        decoded = np.concatenate(tags)[which.ravel()]
    at, out = 0, []
    for text, own, b in zip(texts, starts, base):
        part = decoded[at : at + len(own)]
        at += len(own)
        added = []
        if own:
            taken = np.zeros(len(text) + 1, bool)
            for _, low, high in b:
                taken[low:high] = True
            for span in spans_of(reconciled(len(text), own, part)):
                if not taken[span[1] : span[2]].any() and plausible(span, text):
                    added.append(span)
        out.append((b, ordered(b + added)))
    return out


FOUND = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64())]
    + [(f"n_{k}", pa.int64()) for k in KINDS]
    + [("base_sha256", pa.string()), ("spans", pa.string())]
)


def _find(weights, batches):
    network = Network(weights) if weights else None
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(low, ROWS_AT_ONCE)
            found = found_in(list(strings(part.column(1))), network)
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in KINDS]
            digests = [hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in found]
            columns = [part.column(0), *[pa.array(c, pa.int64()) for c in counts]]
            columns += [pa.array(digests, pa.string())]
            columns += [pa.array([shown(every) for _, every in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """At most ``SAMPLE`` texts of at most ``LONGEST`` characters that hold an at sign or five
    digits in a row or dotted: one per hash value of the id."""
    rows = documents(docs, id_col, text_col).where(
        F.col("doc_id").isNotNull()
        & (F.length("text") <= LONGEST)
        & F.col("text").rlike(r"@|[0-9]{5}|[0-9]\.[0-9]+\.[0-9]|\+[0-9]")
    )
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SAMPLE)).alias("place")
    chosen = rows.groupBy(place).agg(F.min("doc_id").alias("doc_id"))
    ids = [r["doc_id"] for r in chosen.collect()]
    texts = documents(docs, id_col, text_col).where(F.col("doc_id").isin(ids) & (F.length("text") <= LONGEST))
    by_id = {r["doc_id"]: r["text"] for r in texts.collect()}
    return [by_id[i] for i in sorted(by_id)]


def personal_data(
    docs: DataFrame,
    weights: dict[str, np.ndarray] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, base spans per kind, base_sha256 and all spans."""
    if weights is None:
        weights = train(sample(docs, id_col, text_col))
    return documents(docs, id_col, text_col).mapInArrow(functools.partial(_find, weights), FOUND)
