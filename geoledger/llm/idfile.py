"""Token-id files: documents in id order, each compressed on its own with one shared zstandard dictionary.

A set is a Parquet folder of blocks, so that Spark's committer makes writing atomic, lost executors included, and any
store that Spark reads will do. One row is one block of consecutive documents:

    part, block      place in the order; documents ascend by (part, block)
    first_doc, last_doc, n_docs, n_tokens
    within           ids of this part's earlier blocks
    dictionary       XXH64 of the dictionary that its frames need
    offsets          little-endian u64 x (n_docs + 1): where each document's frame begins in ``frames``
    doc_ids          little-endian i64 x n_docs, after one null flag byte each
    counts           little-endian u32 x n_docs: ids in each document
    frames           one zstandard frame for each document, of its ids as little-endian u32

and the dictionary itself is a row of a second folder. Reading one short document takes its block's offset index and one
frame: Parquet's statistics of first_doc and last_doc skip the other blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoledger.llm.common import keep, scratch, table, text_slices
from geoledger.llm.tokens import default_tokenizer, encode, encode_all

#: The dictionary is trained on about so many documents, of each at most so many bytes of ids; of a long one's text on four
#: slices of so many characters, evenly from beginning to end.
SAMPLE_DOCS, SAMPLE_BYTES, SLICE_CHARS = 1_000, 8_192, 1_000
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
#: A block ends at so many documents or bytes of frames, whichever comes first.
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20
#: Texts' bytes for each task that writes, while there are no more tasks than a shuffle bears; then tasks grow and spill.
TASK_BYTES, MOST_TASKS = 64 << 20, 100_000
#: Parts whose running sums may be broadcast (16 bytes each); with more, they are joined by a shuffle.
BROADCAST_PARTS = 1_000_000
BLOCK = "part int, block int, first_doc long, last_doc long, n_docs int, n_tokens long, within long, dictionary string, offsets binary, doc_ids binary, counts binary, frames binary"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of the serialized id arrays; empty if there is too little to learn from."""
    samples = [s for s in samples if s]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4), samples).as_bytes()
    except zstandard.ZstdError:  # the samples are too small or too alike for one
        return b""


def dictionary_hash(data: bytes) -> str:
    return xxhash.xxh64_hexdigest(data)


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class BlockWriter:
    """Gathers documents and makes blocks of them."""

    def __init__(self, part: int, dictionary: bytes, level: int = LEVEL):
        self._part, self._block, self._within, self._hash = part, 0, 0, dictionary_hash(dictionary)
        self._zstd = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_content_size=True)
        self._clear()

    def _clear(self) -> None:
        self._ids, self._counts, self._frames, self._size = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._ids.append(doc_id)
        self._counts.append(len(ids) // 4)
        self._frames.append(self._zstd.compress(ids))
        self._size += len(self._frames[-1])

    def full(self) -> bool:
        return len(self._ids) >= BLOCK_DOCS or self._size >= BLOCK_BYTES

    def block(self) -> tuple:
        known = [i for i in self._ids if i is not None]
        row = (
            self._part, self._block, min(known, default=None), max(known, default=None), len(self._ids), sum(self._counts), self._within, self._hash,
            np.cumsum([0, *map(len, self._frames)]).astype("<u8").tobytes(),
            bytes(i is None for i in self._ids) + np.array([i or 0 for i in self._ids], "<i8").tobytes(),
            np.array(self._counts, "<u4").tobytes(), b"".join(self._frames),
        )
        self._block += 1
        self._within += sum(self._counts)
        self._clear()
        return row

    def __len__(self) -> int:
        return len(self._ids)


def read_block(offsets: bytes, doc_ids: bytes, frames: bytes, dictionary: bytes, only: set[int] | None = None) -> Iterator[tuple[int, int | None, bytes]]:
    """(place in the block, doc_id, ids as bytes), of all documents or those named; other frames aren't touched."""
    at = np.frombuffer(offsets, "<u8").tolist()
    n = len(at) - 1
    zstd = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    for k, (null, doc_id) in enumerate(zip(doc_ids[:n], np.frombuffer(doc_ids[n:], "<i8").tolist())):
        if only is None or (not null and doc_id in only):
            yield k, None if null else doc_id, zstd.decompress(frames[at[k] : at[k + 1]])


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, added: bool = False) -> str:
    """Write all documents' ids, each followed by the end id, under ``path`` (which must not exist) in ascending doc_id.

    docs: doc_id, text. A null text is empty; a null doc_id comes first; rows with the same id follow each other, ordered
    by their texts' hash. An empty table gives a set without blocks. ``added`` as in tokens.encoder. Returns ``path``.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = narrow.count()
    share = min(1.0, SAMPLE_DOCS / max(1, total))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 20)) < F.lit(max(1, round(share * (1 << 20))))
    slices = f"transform(sequence(0, 3), k -> substring(text, cast(1 + k * (length(text) - {SLICE_CHARS}) div 3 as int), {SLICE_CHARS}))"
    sample = narrow.where(draw).select(F.expr(f"if(length(text) > {4 * SLICE_CHARS}, array_join({slices}, ' '), text) as text"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).limit(4 * SAMPLE_DOCS)  # SAMPLE_DOCS rows on average, whatever the input
    drawn = [(encode(r["text"] or "", tokenizer, added)[:SAMPLE_BYTES], r["size"]) for r in sample.toLocalIterator()]
    data = train_dictionary([ids for ids, _ in drawn])
    spark.createDataFrame([(dictionary_hash(data), bytearray(data))], "dictionary string, data binary").write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BlockWriter(TaskContext.get().partitionId(), shared.value)
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("within", pa.int64()), ("dictionary", pa.string()), *((c, pa.binary()) for c in ("offsets", "doc_ids", "counts", "frames"))])
        rows = lambda row: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
        for batch, texts in text_slices(batches, memos=True):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(texts, tokenizer, added)):
                writer.add(doc_id, ids)
                if writer.full():
                    yield rows(writer.block())
        if len(writer):
            yield rows(writer.block())

    tasks = max(spark.sparkContext.defaultParallelism, min(MOST_TASKS, -(-_text_bytes([size for _, size in drawn], total) // TASK_BYTES)))
    ordered = narrow.repartitionByRange(tasks, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))  # rows of one id are no one task
    ordered.mapInArrow(run, BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def _text_bytes(sizes: list[int], total: int) -> int:
    """About how many bytes the texts have, by the mean of the sample."""
    return int(sum(sizes) / max(1, len(sizes)) * total)


def read_ids(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before it. ``only`` names documents."""
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    data = {r["dictionary"]: bytes(r["data"]) for r in spark.read.schema("dictionary string, data binary").parquet(f"{path}/dictionary").collect()}  # one row
    if broken := [name for name, bytes_ in data.items() if dictionary_hash(bytes_) != name]:
        raise ValueError(f"dictionary {broken[0]} does not have the hash that it is named by")
    wanted = None if only is None else set(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["part", "local", "doc_id", "n_tokens", "ids"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                before = row["within"] + np.cumsum(np.frombuffer(row["counts"], "<u4").astype(np.int64)) - np.frombuffer(row["counts"], "<u4")
                found = read_block(row["offsets"], row["doc_ids"], row["frames"], data[row["dictionary"]], wanted)
                out = [(row["part"], int(before[k]), doc_id, len(ids) // 4, ids) for k, doc_id, ids in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    before = _parts_before(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")))
    if (blocks.agg(F.max("part")).first()[0] or 0) < BROADCAST_PARTS:
        before = F.broadcast(before)
    if wanted is not None:
        blocks = blocks.where(F.exists(F.array(*map(F.lit, sorted(wanted))).cast("array<bigint>"), lambda i: F.col("first_doc").isNotNull() & i.between(F.col("first_doc"), F.col("last_doc"))))
    found = blocks.select("part", "within", "offsets", "doc_ids", "counts", "frames", "dictionary")
    found = found.mapInArrow(run, "part int, local long, doc_id long, n_tokens long, ids binary")
    return found.join(before, "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids")


def _parts_before(parts: DataFrame, group: int = 1_000) -> DataFrame:
    """(part, before): the sum of n over smaller parts, in two levels, so that no task sees more than a thousandth of them."""
    parts = parts.withColumn("group", F.expr(f"part div {group}"))
    inner = F.sum("n").over(Window.partitionBy("group").orderBy("part")) - F.col("n")
    groups = parts.groupBy("group").agg(F.sum("n").alias("all"))
    outer = groups.select("group", (F.sum("all").over(Window.orderBy("group")) - F.col("all")).alias("outer"))
    return parts.withColumn("inner", inner).join(outer, "group").select("part", (F.col("inner") + F.col("outer")).alias("before"))


def op10(spark, sf_dir: str) -> DataFrame:
    """What the files hold of every document: where its ids start, how many there are, and their checksum."""
    path = write_ids(table(spark, sf_dir, "documents"), keep(spark, f"{scratch(spark)}/ids-{uuid.uuid4().hex}"), added=True)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
