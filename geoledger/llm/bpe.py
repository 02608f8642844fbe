"""Byte-level BPE by monoid tree reduction: encode halves, join neighbours, and never look further than a seam needs.

Encodings of adjacent byte strings are joined by re-encoding a window of tokens around the seam. The window grows until
its outermost tokens come out as they went in; then nothing outside can change. Proof: merging always takes the pair of
least rank, the leftmost of equals, so what happens inside an interval that no merge crosses is what happens to that
interval alone. Call neighbouring tokens stable if the two encode, together and alone, to themselves.
(1) Neighbours in an encoding are stable: no merge ever crossed the edges of a final token.
(2) A string of tokens whose neighbours are all stable is the encoding of its bytes: take the first merge that would cross
an edge between two of them. Until then all merges were inside tokens, so it would also be the next merge of those two
alone, which are stable. So none crosses, and each token is formed as it is in its pair.
In the joined string every pair of neighbours lies inside the left encoding, the right one, or the window's, which meet in
a shared token; by (1) they are stable, and by (2) the string is the encoding. A seam whose two tokens are stable needs no
window at all. If the window grows to the whole string, its encoding is the answer by definition.

Decoding is the monoid's other direction: concatenation, up the tree.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.llm.common import table, text_slices
from geoledger.llm.pretoken import PieceEncoder

#: Up to so many bytes are merged directly.
LEAF_BYTES = 10
#: Longer windows are merged with a heap; up to so many bytes what a window encodes to is remembered.
_SHORT, _KEPT = 48, 20
_MEMO = 200_000
_NO_RANK = 1 << 62


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class TreeBpe:
    """Encodes and decodes byte strings by ranks, a dict of token bytes to id; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF_BYTES):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self._leaf = leaf
        self._windows: dict[bytes, tuple[int, ...]] = {}
        self._stable: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding of a short string: merge the pair of least rank, leftmost first, while there is one."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], _NO_RANK) for i in range(len(data) - 1)]
        while pairs:
            least = min(pairs)
            if least == _NO_RANK:
                break
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], _NO_RANK)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], _NO_RANK)
        return [self.ranks[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """The same for a long string, with a heap of (rank, place); outdated entries are skipped."""
        n, rank = len(data), self.ranks.get
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray([1]) * n
        heap = []

        def offer(i: int) -> None:
            if end[i] < n and (r := rank(data[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        for i in range(n):
            offer(i)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens next to each other encode to themselves."""
        known = self._stable.get((a, b))
        if known is None:
            if len(self._stable) >= _MEMO:
                self._stable.clear()
            known = self._stable[a, b] = self._direct(self.tokens[a] + self.tokens[b]) == (a, b)
        return known

    def _direct(self, data: bytes) -> tuple[int, ...]:
        if len(data) > _KEPT:
            return tuple(self.merge(data) if len(data) <= _SHORT else self.merge_long(data))
        known = self._windows.get(data)
        if known is None:
            if len(self._windows) >= _MEMO:
                self._windows.clear()
            known = self._windows[data] = tuple(self.merge(data))
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two encodings' bytes together."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        reach = 1
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = self._direct(b"".join(map(self.tokens.__getitem__, left[i:] + right[:j])))
            if (not i or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            reach *= 2

    def encode(self, data: bytes) -> tuple[int, ...]:
        """Encode halves and join them; the tree is as deep as the logarithm of the length."""
        if len(data) <= self._leaf:
            return self._direct(data)
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def piece(self, data: bytes) -> list[int]:
        """One match of the pattern: itself if it is a token, as the tiktoken library has it."""
        known = self.ranks.get(data)
        return list(self.encode(data)) if known is None else [known]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4_096:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def read_ranks(path: str) -> dict[bytes, int]:
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


@cache
def token_table(path: str) -> pa.Array:
    """The tokens' bytes by id; null where there is none, which would make a text null and so be seen."""
    ranks = read_ranks(path)
    held: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        held[i] = token
    return pa.array(held, pa.binary())


@cache
def codec(path: str) -> tuple[Callable[[str], bytes], TreeBpe]:
    """A function from whole texts to ids as bytes, and the coder behind it; one for each worker process."""
    import public_tokenizers

    coder = TreeBpe(read_ranks(path))
    packed = {i: i.to_bytes(4, "little") for i in coder.tokens}
    one = lambda piece: b"".join(map(packed.__getitem__, coder.piece(piece.encode())))
    return PieceEncoder(public_tokenizers.PATTERN, one).encode, coder


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): ids array<int> of each whole text; a null or empty text has none. One row for each input row."""
    path = path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = codec(path)
        for batch, texts in text_slices(batches):
            ids = [encode(t) for t in texts]
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): decoded is the ids' bytes, concatenated by Arrow over a whole batch.

    Null ids decode to no bytes; an id beyond the vocabulary is an error.
    """
    path = path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, nothing = token_table(path), pa.scalar(b"", pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(1)
                ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy()))).astype(np.int32)
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens.take(ids.flatten())), nothing)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, texts], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def op8(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    both = decode_documents(encode_documents(table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
