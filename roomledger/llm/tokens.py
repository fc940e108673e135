"""Fast paths to the ids and counts of a public tokenizer, shared by two operators.

Both vocabularies split a text into pre-tokens before any merge, so the result for
a piece of text between two safe cuts depends on that piece alone and can be kept.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# The pre-token patterns and the printable byte alphabet of the vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Blanks for Python but not for the tokenizers, or the reverse: such texts go to the library whole.
ODD = re.compile("[\x1c-\x1f\x85᠎​﻿]")
#: Marks that form one pre-token with each other and with nothing else.
MARKS = ".,;:!?|#$%&*"
#: A cut before a blank is safe where no blank stands before it.
AFTER_TEXT = re.compile(r"(?<=\S) ")
RUN = re.compile(r"\s ")


def _alphabet() -> dict[int, str]:
    """Latin-1 character of each byte -> the character that the vocabularies use for it."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(rest)}


ALPHABET = _alphabet()


@functools.lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def strings(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def unassigned(piece: str) -> bool:
    """Whether a character is in doubt: tables of a newer Unicode may call it a letter or number,
    and ``regex`` and the tokenizers do not have the same tables."""
    return not piece.isascii() and not piece.isprintable() and any(unicodedata.category(c) == "Cn" for c in piece)


def as_bytes(piece: str) -> str:
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(ALPHABET)


def gathered(pool: list[bytes], codes: np.ndarray, ends: np.ndarray):
    """Concatenates the 32-bit values in ``pool[c]`` over ``codes``; also where each row's
    stretch ends, ``ends`` being where it ends in ``codes``."""
    lengths = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
    starts = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(pool), "<u4")
    taken = lengths[codes]
    stops = np.cumsum(taken)
    at = np.repeat(starts[codes] - (stops - taken), taken)
    at += np.arange(len(at))
    return flat[at], np.concatenate(([0], stops))[ends]


class WordIds:
    """Ids of whole texts under a vocabulary that drops white space."""

    #: Kept words; beyond it the cache starts anew. Workers keep it between tasks, so it
    #: must leave room for what other stages do in the same worker.
    LIMIT = 300_000

    def __init__(self, path: str) -> None:
        self.whole = library(path)
        self.model = self.whole.model
        self.normal = self.whole.normalizer.normalize_str
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.find = regex.compile(WORD_PATTERN).findall
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = array("I", [t.id for t in self.model.tokenize(as_bytes(word))]).tobytes()
            self.words[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(MARKS)
        low = word.lower()
        if low.isalpha() and (
            word.isascii() or "\u03a3" not in word and unicodedata.is_normalized("NFC", word)
        ):
            found = self._word(low)
            return found + self._word(chunk[len(word) :]) if len(word) < len(chunk) else found
        if "<|" in chunk and any(s in chunk for s in self.special) or unassigned(chunk):
            return self._library(chunk)
        return b"".join(map(self._word, self.find(self.normal(chunk))))

    def _library(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) > self.LIMIT:
            self.words = {}
        odd = [i for i, t in enumerate(strings(texts)) if ODD.search(t)]
        chunks = pc.utf8_split_whitespace(texts)
        coded = chunks.values.dictionary_encode()
        pool = [self._chunk(c) for c in strings(coded.dictionary)]
        ids, ends = gathered(pool, coded.indices.to_numpy(), chunks.offsets.to_numpy())
        found = [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        for i in odd:
            found[i] = self._library(texts[i].as_py())
        return found


class BytePretokens:
    """Pre-tokens of whole texts under a byte-level vocabulary."""

    LIMIT = 600_000

    def __init__(self, path: str) -> None:
        self.whole = library(path)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self._matches = regex.compile(BYTE_PATTERN).findall

    def find(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if unassigned(text):
            return [text[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text)]
        return self._matches(text)

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text or of a piece between safe cuts; special strings stand alone."""
        if "<|" in text:
            found: list[str] = []
            for i, part in enumerate(self.at_special.split(text)):
                found += [part] if i % 2 else self.find(part)
            return found
        return self.find(text)

    def pieces(self, pretoken: str) -> int:
        """Ids of one pre-token."""
        if pretoken in self.special:
            return 1
        return len(self.model.tokenize(as_bytes(pretoken)))

    def single(self) -> set[str]:
        """The pre-tokens that are one id, at most as many as the vocabulary has."""
        back = {v: k for k, v in ALPHABET.items()}
        found = set(self.special)
        for entry in self.whole.get_vocab(with_added_tokens=False):
            try:
                text = entry.translate(back).encode("latin-1").decode("utf-8")
            except UnicodeError:
                continue
            if self.find(text) == [text] and self.pieces(text) == 1:
                found.add(text)
        return found


def safe_pieces(text: str) -> list[str]:
    """A text cut before blanks; every piece but the first has lost its blank."""
    return AFTER_TEXT.split(text) if RUN.search(text) else text.split(" ")
