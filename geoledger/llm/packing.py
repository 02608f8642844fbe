"""Packing documents into sequences of a fixed window, with next to no padding.

A document's ids are cut into full windows, which are sequences of their own, and a remainder below the window. The
remainders' lengths are a histogram of ``window - 1`` bins however many documents there are. On it the driver plans:

1. enumerate shallow combinations of two or three lengths that fill the window exactly;
2. solve non-negative least squares for how often each is to repeat, so that together they meet the histogram;
3. round the counts down to what is there;
4. pack what remains greedily, longest first, each time with the longest that fits; lengths that leave a gap so go end to
   end, cut where windows end.

The plan says which ranks of each length go to which sequence and offset. Ranks are counted by length and hash bucket, so
a length that a third of all documents have is spread over many tasks. Only remainders are shuffled, never full windows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoledger.llm.common import BATCH_ROWS, table, text_slices, written
from geoledger.llm.tokens import default_tokenizer, encode_all

WINDOW = 1024
#: Buckets that a length's ranks are counted in: at least so many, and one for so many remainders.
BUCKETS, BUCKET_ROWS = 256, 2_000_000
#: The most frequent lengths, which combinations of three may hold.
TRIPLE_LENGTHS = 12
SWEEPS = 40


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int = WINDOW, often: int = TRIPLE_LENGTHS) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to the window: all pairs, and triples with a frequent length."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    pairs = [(a, window - a, 0) for a in lengths.tolist() if 2 * a <= window and there[window - a]]
    common = lengths[np.argsort(-counts, kind="stable")[:often]].tolist()
    triples = {tuple(sorted((a, b, window - a - b))) for a in common for b in lengths.tolist() if a + b < window and there[window - a - b]}
    return np.array([*pairs, *sorted(triples)], np.int64).reshape(-1, 3)


def nnls(combos: np.ndarray, histogram: np.ndarray, sweeps: int = SWEEPS, tolerance: float = 1e-3) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ||A x - histogram||, by cyclic coordinate descent.

    A's column j counts the lengths in combination j. Each step is the exact minimum along one coordinate.
    """
    columns = []
    for combo in combos.tolist():
        found: dict[int, int] = defaultdict(int)
        for length in combo:
            if length:
                found[length] += 1
        columns.append((tuple(found.items()), sum(n * n for n in found.values())))
    x, rest = [0.0] * len(columns), histogram.astype(float).tolist()
    for _ in range(sweeps):
        moved = 0.0
        for j, (column, norm) in enumerate(columns):
            step = max(-x[j], sum(n * rest[k] for k, n in column) / norm)
            if step:
                x[j] += step
                for k, n in column:
                    rest[k] -= n * step
                moved = max(moved, abs(step))
        if moved < tolerance:
            break
    return np.array(x)


class _Stock:
    """What is left of each length, and the plan's rows (remainder, rank from, rank to, position of the first, stride)."""

    def __init__(self, histogram: np.ndarray, window: int):
        self.window, self.sequences = window, 0
        self.taken = {k: 0 for k, n in enumerate(histogram) if n and k}
        self.left = {k: int(histogram[k]) for k in self.taken}
        self.rows: list[tuple[int, int, int, int, int]] = []

    def _place(self, length: int, n: int, position: int, stride: int) -> None:
        self.rows.append((length, self.taken[length], self.taken[length] + n, position, stride))
        self.taken[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def fill(self, lengths: list[int], n: int) -> None:
        """n sequences of these lengths, which add up to the window."""
        at = self.sequences * self.window
        for length in lengths:
            self._place(length, n, at, self.window)
            at += length
        self.sequences += n

    def best_fit(self, length: int) -> tuple[list[int], int]:
        """This length and, again and again, the longest that fits what it leaves of a window; and the gap at the end."""
        left, gap, lengths = dict(self.left), self.window, []
        while length:
            lengths.append(length)
            left[length] -= 1
            gap -= length
            length = max((k for k, n in left.items() if n and k <= gap), default=0)
        return lengths, gap

    def run_on(self, length: int, position: int) -> int:
        """All that is left of a length end to end from this position on; windows cut it. The position after it."""
        n = self.left[length]
        self._place(length, n, position, length)
        return position + n * length


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (remainder, rank from, rank to, position, stride), and how many sequences they fill.

    histogram[k]: remainders of length k, 0 < k < window. A remainder of rank r in a row lies at position
    ``position + (r - rank from) * stride`` of all sequences end to end. Every rank is in just one row, all sequences but
    one at most are full, and the rows' number is bounded by the window, not by the counts.
    """
    stock = _Stock(histogram, window)
    lengths = np.flatnonzero(histogram)
    lengths = lengths[lengths > 0]
    combos = combinations(lengths, histogram[lengths], window)
    wanted = nnls(combos, histogram) if len(combos) else np.zeros(0)
    for j in np.argsort(-wanted, kind="stable").tolist():
        parts = [k for k in combos[j].tolist() if k]
        n = int(min(np.floor(wanted[j] + 0.5), *(stock.left.get(k, 0) // parts.count(k) for k in parts)))
        if n > 0:
            stock.fill(parts, n)
    cut = []
    for length in sorted(stock.left, reverse=True):
        while stock.left.get(length):
            parts, gap = stock.best_fit(length)
            if gap:
                cut.append(length)
                break
            stock.fill(parts, min(stock.left[k] // parts.count(k) for k in set(parts)))
    end = stock.sequences * window
    for length in cut:
        if stock.left.get(length):
            end = stock.run_on(length, end)
    return stock.rows, -(-end // window)


def tokenized(docs: DataFrame, path: str | None = None, window: int = WINDOW, added: bool = False) -> DataFrame:
    """(doc_id, doc_tokens, start, length, ids): each document's ids, its end id last, cut at whole windows; ``added`` as in tokens.encoder."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, memos=True, rows=BATCH_ROWS):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(texts, path, added)):
                n = len(ids) // 4
                rows += [(doc_id, n, at, min(window, n - at), ids[4 * at : 4 * (at + window)]) for at in range(0, n, window)]
            kinds = (*[pa.int64()] * 4, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "doc_tokens", "start", "length", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, doc_tokens long, start long, length long, ids binary")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, added: bool = False) -> DataFrame:
    """(doc_id, doc_tokens, start, length, sequence_id, offset, ids): every piece, with its ids as bytes.

    docs: doc_id, text; a null text is empty and so is one end id. Rows with the same or no doc_id are packed as documents
    of their own. Sequences of whole windows have odd ids and the packed ones even ids. An empty table has no pieces.
    """
    spark = docs.sparkSession
    chunks = written(tokenized(docs, path, window, added).withColumn("uid", F.monotonically_increasing_id()), "chunks")
    names = ["doc_id", "doc_tokens", "start", "length", "sequence_id", "offset", "ids"]
    full = chunks.where(F.col("length") == window)
    full = full.withColumns({"sequence_id": 2 * F.col("uid") + 1, "offset": F.lit(0).cast("long")})

    rest = chunks.where(F.col("length") < window).withColumn("remainder", F.col("length").cast("int")).drop("length")
    buckets = max(BUCKETS, -(-rest.count() // BUCKET_ROWS))
    light = rest.select("uid", "remainder").withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int"))
    sizes = light.groupBy("remainder", "bucket").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("remainder").orderBy("bucket")) - F.col("count"))
    histogram = np.zeros(window, np.int64)
    for row in light.groupBy("remainder").count().collect():  # below ``window`` rows
        histogram[row["remainder"]] = row["count"]
    planned, _ = plan(histogram, window)
    schema = "remainder int, rank_from long, rank_to long, position long, stride long"
    lots = spark.createDataFrame(planned, schema)

    own = F.row_number().over(Window.partitionBy("remainder", "bucket").orderBy("uid")) - 1
    ranked = light.withColumn("own", own).join(before.drop("count"), ["remainder", "bucket"])
    ranked = ranked.select("uid", "remainder", (F.col("own") + F.col("before")).alias("rank"))
    placed = ranked.join(F.broadcast(lots), "remainder").where("rank >= rank_from and rank < rank_to")  # lots: the plan's rows, bounded by the window
    placed = placed.select("uid", (F.col("position") + (F.col("rank") - F.col("rank_from")) * F.col("stride")).alias("at"))
    pieces = rest.join(placed, "uid").withColumn("room", window - F.col("at") % window)
    cut = "array(struct(0L as cut, least(remainder, room) as length), struct(room as cut, remainder - room as length))"
    pieces = pieces.select("*", F.explode(F.expr(f"filter({cut}, x -> x.length > 0)")).alias("part")).select("*", "part.*")
    pieces = pieces.withColumns(
        {
            "start": F.col("start") + F.col("cut"),
            "sequence_id": 2 * F.expr(f"(at + cut) div {window}"),
            "offset": (F.col("at") + F.col("cut")) % window,
            "ids": F.expr("substring(ids, cast(4 * cut + 1 as int), cast(4 * length as int))"),
        }
    )
    return full.select(names).unionByName(pieces.select(names))


def pieces(docs: DataFrame) -> DataFrame:
    """Where each piece of every document went, with the unsigned checksum of its ids, which are the library's by default."""
    return pack(docs, added=True).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1(spark, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return pieces(table(spark, sf_dir, "documents"))
