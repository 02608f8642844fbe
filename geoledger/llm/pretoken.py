"""Splitting text into byte-level BPE pre-tokens with bounded memory, and memoising what each piece encodes to.

Byte-level BPE encodes every match of its pattern separately. A match can only begin at a space that a non-space character
follows, or later: the white space before such a space ends there as well, since ``\\s+(?!\\S)`` gives its last character
back. So a text cut before those spaces encodes to the concatenation of its parts' ids. The parts are words, which repeat,
so a part is looked up first and only a new one is matched against the pattern.

Many texts are cut together, in Arrow: each different part is looked up once, and the texts' ids are gathered by the parts'
places. These parts are cut further, where matches surely end: marks that end a line or a word after a letter or a digit are
one match, and so is a line's end between characters that are no white space. So "word", "word." and "word,\\nWord" have one
part in common.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_CUT = re.compile(r"(?= \S)")
#: Characters worked on at once; cuts fall where parts do.
BLOCK_CHARS = 1_000_000
#: Neither letters, numbers nor white space; several after a word are one match of the pattern.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Longer pieces are encoded each time instead of being remembered, and so are two words around a line's end, which hardly repeat.
LONGEST_KEPT = 64
#: Characters of texts that are cut together, and the longest run of marks that is cut off.
TOGETHER_CHARS, LONGEST_MARKS = 4 * BLOCK_CHARS, 8
#: By byte: marks; ASCII letters and digits; what a character begins with that is no white space, or is left to the pattern.
_MARK = np.isin(np.arange(256), list(_MARKS.encode()))
_PLAIN = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_BEGINS = _MARK | _PLAIN | np.isin(np.arange(256), [*range(0xC3, 0xE1), *range(0xE4, 0xF5)])
#: By code point: letters of two bytes.
_LETTER = np.array([c >= 128 and chr(c).isalpha() for c in range(0x800)])


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """Pieces of the text, about ``size`` long, cut only where a part begins."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class _Loose(Exception):
    """White space follows a space, or ends the text: the block has to be cut with care."""


class Recent(dict):
    """A memo of a function: its newest ``limit`` to ``2 * limit`` arguments; a full one becomes the older half."""

    def __init__(self, made: Callable[[str], bytes], limit: int):
        super().__init__()
        self._made, self._limit, self._older = made, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self._older.get(key)
        if value is None:
            value = self._made(key)
            if len(key) > LONGEST_KEPT or "\n" in key[:-1]:
                return value
        if len(self) >= self._limit:
            self._older = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceEncoder:
    """Encodes whole texts by ``encode``, which turns one match of the pattern into bytes of its ids."""

    def __init__(self, pattern: str, encode: Callable[[str], bytes], words: int = 380_000, pieces: int = 50_000):
        self._find, self._encode = regex.compile(pattern).findall, encode
        self._pieces = Recent(encode, pieces)
        self._after_space = Recent(self._word, words)

    def _matched(self, part: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self._find(part)))

    def _word(self, word: str) -> bytes:
        """A space and a word. Letters, marks after letters, and a line's end between words need no pattern."""
        if word.isalpha():
            return self._encode(" " + word)
        if not word or word[0].isspace():
            raise _Loose
        core = word.rstrip(_MARKS)
        if core.isalpha():
            return self._after_space[core] + self._pieces[word[len(core) :]]
        line, end, after = word.partition("\n")
        if end and after.isalpha() and not line[-1].isspace():
            return self._after_space[line] + self._pieces["\n"] + self._pieces[after]
        return self._matched(" " + word)

    def encode(self, text: str) -> bytes:
        out = []
        for block in blocks(text):
            first, *rest = block.split(" ")
            try:
                if block[:1].isspace():
                    raise _Loose
                out.append(b"".join([self._matched(first), *map(self._after_space.__getitem__, rest)]))
            except _Loose:
                out.extend(map(self._matched, _CUT.split(block)))
        return out[0] if len(out) == 1 else b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """What encode gives for each text. Texts beyond a block, and those with white space beside a space, are encoded on their own."""
        out, some, chars = [b""] * len(texts), [], 0
        for k, text in enumerate(texts):
            if len(text) > BLOCK_CHARS or text[:1].isspace() or text[-1:] == " " or "  " in text:
                out[k] = self.encode(text)
            elif text:
                if chars + len(text) > TOGETHER_CHARS:
                    self._together(texts, some, out)
                    some, chars = [], 0
                some.append(k)
                chars += len(text)
        if some:
            self._together(texts, some, out)
        return out

    def _together(self, texts: list[str], some: list[int], out: list[bytes]) -> None:
        """Encode the texts at the places ``some``, which have no empty words, into ``out``."""
        words = pc.split_pattern(pa.array([texts[k] for k in some], pa.string()), " ")
        flat, first = words.flatten(), words.offsets.to_numpy()[:-1]
        begin, data = np.frombuffer(flat.buffers()[1], np.int32)[: len(flat) + 1], flat.buffers()[2]
        after_space = np.zeros(begin[-1] + 1, bool)
        after_space[begin] = True
        after_space[begin[first]] = False
        cuts = _cuts(np.frombuffer(data, np.uint8)[: begin[-1]], begin)
        after_space = after_space[cuts[:-1]]

        keys, codes = _different(cuts, data, after_space)
        values = list(map(self._after_space.get, keys))
        new = [k for k, value in enumerate(values) if value is None]  # one after the other, as that keeps the model's tables near
        loose = np.zeros(len(values), bool)
        for k in new:
            try:
                values[k] = self._after_space[keys[k]]
            except _Loose:
                loose[k] = True
        keys, others = _different(cuts, data, ~after_space)
        codes = np.where(after_space, codes, len(values) + others)
        values += [self._pieces[part] if part.isalpha() else self._matched(part) for part in keys]

        starts = np.append(np.searchsorted(cuts, begin[first]), len(codes))
        got = pa.array(values, pa.binary()).take(pa.array(codes))
        at, ids = np.frombuffer(got.buffers()[1], np.int32)[starts].tolist(), got.buffers()[2]
        alone = np.flatnonzero(after_space)[loose[codes[after_space]]] if loose.any() else []
        alone = set((np.searchsorted(starts, alone, "right") - 1).tolist())
        for j, (k, a, b) in enumerate(zip(some, at, at[1:])):
            out[k] = self.encode(texts[k]) if j in alone else ids.slice(a, b - a).to_pybytes()


def _cuts(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where parts begin, and the end: words end to end in ``data`` begin at ``begin`` (the last is its length), none of them empty."""
    cut = np.zeros(len(data) + 1, bool)
    cut[begin] = True

    def plain(at: np.ndarray) -> np.ndarray:
        """Whether a letter or a digit ends at these places; a letter of three bytes doesn't count."""
        last, before = data[at - 1].astype(np.int32), data[np.maximum(at - 2, 0)].astype(np.int32)
        return _PLAIN[last] | ((last & 0xC0 == 0x80) & (before & 0xE0 == 0xC0) & _LETTER[(before & 0x1F) << 6 | last & 0x3F])

    line = np.flatnonzero(data == 10)
    line = line[~cut[line] & ~cut[line + 1]]
    line = line[_BEGINS[data[line + 1]] & (_MARK[data[line - 1]] | plain(line))]
    cut[line] = cut[line + 1] = True

    cuts = np.flatnonzero(cut)
    low, at = cuts[:-1], cuts[1:]
    low, at = low[_MARK[data[at - 1]]], at[_MARK[data[at - 1]]]
    for _ in range(LONGEST_MARKS):
        at = at - ((at > low) & _MARK[data[at - 1]])
    at = at[at > low]
    cut[at[plain(at)]] = True
    return np.flatnonzero(cut).astype(np.int32)


def _different(cuts: np.ndarray, data: pa.Buffer, which: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The different parts among those named, and of each of those its place there; the other places mean nothing."""
    n, named = len(which), pa.py_buffer(np.packbits(which, bitorder="little"))
    found = pa.StringArray.from_buffers(n, pa.py_buffer(cuts), data, named, n - int(which.sum())).dictionary_encode()
    places = np.frombuffer(found.indices.buffers()[1], np.int32)[:n]
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), np.where(which, places, 0)
