"""Statistics of a text, for rules and classifiers: counts of its words, lines, symbols and repeats."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
#: Odd multipliers of a window's word numbers; equal sums are only a hint and are checked exactly.
_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ** 5 | 1) % 2**64 for k in range(WINDOW_WORDS)], np.uint64)
#: The columns of features(), in order; and which way quality may go with each (for constrained models).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "upper": -1, "letters": 0, "digits": 0,
    "punctuation": 0, "distinct": 0, "top_word": 0, "same_as_last": -1, "longest_word": 0, "line_words": 0, "shouts": -1, "bars": -1,
}
_UPPER, _LETTER, _DIGIT, _SPACE, _PUNCT, _OTHER = range(6)


@dataclass(frozen=True)
class Stats:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: tuple[float, ...]

    @property
    def base_failed(self) -> bool:
        """Too short, or more than three in ten of its words in repeated windows."""
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


@cache
def _kinds() -> np.ndarray:
    """The kind of every code point there is."""

    def kind(c: str) -> int:
        if c.isalpha():
            return _UPPER if c.isupper() else _LETTER
        return _DIGIT if c.isdigit() else _SPACE if c.isspace() else _PUNCT if unicodedata.category(c)[0] in "PS" else _OTHER

    return np.fromiter((kind(chr(c)) for c in range(0x110000)), np.uint8, 0x110000)


def _kind_counts(text: str) -> np.ndarray:
    total = np.zeros(6, np.int64)
    for at in range(0, len(text), 1 << 20):
        points = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "replace"), "<u4")
        total += np.bincount(_kinds()[points], minlength=6)
    return total


def _pairs(a: np.ndarray, step: int) -> np.ndarray:
    """A number for each pair (a[i], a[i + step]); equal pairs get equal numbers."""
    both = a[:-step].astype(np.int64) * (int(a.max()) + 1) + a[step:]
    return np.unique(both, return_inverse=True)[1]


def repeated_words(words: np.ndarray) -> int:
    """Words, given as numbers below 2**31, in windows of eight that occur twice or more."""
    n = len(words) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    wide = words.astype(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k, m in enumerate(_MIX):
        mixed += wide[k : k + n] * m
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    eights = _pairs(_pairs(_pairs(words, 1), 2), 4)
    twice = np.bincount(eights)[eights] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW_WORDS:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def stats(text: str) -> Stats:
    """The statistics of a whole text; an empty one has zeros."""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    known: dict[bytes, int] = {}
    number = known.setdefault
    ids = np.fromiter((number(w, len(known)) for w in words), np.int64, n)
    word_chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    dups, repeats = len(lines) - len(set(lines)), repeated_words(ids)
    kinds = _kind_counts(text)
    letters = kinds[_UPPER] + kinds[_LETTER]
    per = lambda x, y: float(x) / max(1.0, float(y))
    features = (
        float(np.log1p(n)), per(word_chars, n), per(symbols, n), per(dups, len(lines)), per(repeats, n), per(kinds[_UPPER], letters),
        per(letters, word_chars), per(kinds[_DIGIT], word_chars), per(kinds[_PUNCT], n), per(np.log1p(len(known)), np.log1p(n)),
        per(np.bincount(ids).max() if n else 0, n), per((ids[1:] == ids[:-1]).sum(), n), float(np.log1p(max(map(len, words), default=0))),
        float(np.log1p(per(n, len(lines)))), per(text.count("!"), n), per(text.count("|"), n),
    )
    return Stats(n, word_chars, symbols, dups, repeats, features)
