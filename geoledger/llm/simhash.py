"""SimHash near-duplicates: fingerprints, and their links within two differing bits.

Deletion-variant signatures: a 64-bit fingerprint is cut into two 32-bit segments. Of two fingerprints that differ in at
most two bits, one segment differs in at most one, so they share a variant of that segment with one position wild.
Variants meet by equality, in one shuffle of the variants, and every candidate is verified.

A segment value that very many different fingerprints share (a large group of near copies) would make a bucket of all
their pairs. The rows of such buckets take an exact way of bounded size instead: two fingerprints differ in at most two
bits just if some 64-bit word is within one bit of both, and a word is within one bit of at most 65 fingerprints. So each
fingerprint is linked to the least one around each of its 65 words. No pair is lost, and no bucket exceeds 65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.llm.common import checkpointed, table, text_slices, written
from geoledger.llm.components import components

SEED = 42
SHINGLE_WORDS = 3
#: Different fingerprints with one segment value; above it the value's buckets take the exact way.
HOT_SEGMENT = 64
_BLOCK = 65_536


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """Unsigned SimHash of a text; 0 if it has no word. Lower-casing is of A-Z only, words end at ASCII white space."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last, n = starts[: len(words) - width + 1], ends[width - 1 :], len(words) - width + 1
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + _BLOCK].tolist(), last[at : at + _BLOCK].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keys`` of docs and fp, the fingerprint's 64 bits as a signed long. Null text is empty."""
    narrow = docs.select(*keys, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            bits = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bits)], [*keys, "fp"])

    return narrow.mapInArrow(run, f"{schema}, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """(fp, key) for the 64 one-wildcard variants; key: segment and position above the segment's value without that bit."""
    slot = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("slot"))
    return slot.selectExpr("fp", "shiftleft(cast(slot as bigint), 32) | (shiftrightunsigned(fp, 32 * (slot div 32)) & 4294967295L & ~shiftleft(1L, slot % 32)) as key")


def _hot_keys(fps: DataFrame, limit: int) -> DataFrame:
    halves = fps.select(F.explode(F.expr("array(struct(0 as seg, fp & 4294967295L as val), struct(1 as seg, shiftrightunsigned(fp, 32) as val))")).alias("h")).select("h.*")
    hot = halves.groupBy("seg", "val").count().where(F.col("count") > limit)
    wild = hot.select("seg", "val", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("pos"))
    return wild.selectExpr("shiftleft(cast(seg * 32 + pos as bigint), 32) | (val & ~shiftleft(1L, pos)) as key").distinct()


def links(fps: DataFrame, hot_segment: int = HOT_SEGMENT) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within two bits.

    fps: distinct fp. From buckets of the usual size every such pair comes; from hot ones a chain of links within two
    bits each that joins the same fingerprints.
    """
    keys, hot = _variants(fps), checkpointed(_hot_keys(fps, hot_segment))  # written, so that its size is known to the joins below
    buckets = keys.join(hot, "key", "left_anti").groupBy("key").agg(F.collect_list("fp").alias("near")).where(F.size("near") > 1)  # of two values' rows at most
    pairs = buckets.select(F.explode("near").alias("a"), "near").select("a", F.explode(F.expr("filter(near, b -> a < b and bit_count(a ^ b) <= 2)")).alias("b"))
    if hot.isEmpty():
        return pairs.distinct()
    crowd = keys.join(hot, "key", "left_semi").select("fp").distinct()
    words = crowd.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("j"))
    words = words.selectExpr("fp", "if(j < 0, fp, fp ^ shiftleft(1L, j)) as word")
    around = words.groupBy("word").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    stars = around.select(F.explode("near").alias("a"), F.array_min("near").alias("b")).where("a != b")
    return pairs.unionByName(stars).distinct()


def _classes(marked: DataFrame) -> DataFrame:
    """(fp, root, least) for each fingerprint of (uid, doc_id, fp): least is a struct of its class's first row by id, then uid.

    Copies meet in one fingerprint first (a partial aggregate), so a group of copies of any size is one node.
    """
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "uid")
    nodes = checkpointed(marked.groupBy("fp").agg(F.min(row).alias("first")))
    roots = components(links(nodes.select("fp")), "a", "b").withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return named.join(named.groupBy("root").agg(F.min("first").alias("least")), "root").select("fp", "root", "least")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the least doc_id that links of two bits or fewer reach.

    docs: doc_id, text. Null and wordless texts have fingerprint zero and link like any other. Rows with a null id take
    part; a class in which no row has an id has a null component_id. Repeated rows each come back. An empty table gives an
    empty result.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = checkpointed(fingerprints(narrow, ["doc_id"]).withColumn("uid", F.monotonically_increasing_id()))
    classes = _classes(marked).select("fp", F.col("least.doc_id").alias("component_id"))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, of which one stays from each near-duplicate class.

    It is the one with the least doc_id; a row without an id stays only if its class has none with one. Of repeated rows
    one stays. docs must have doc_id and text.
    """
    uid = next(n for n in (f"_row{k}" for k in range(10**6)) if n not in docs.columns)
    stored = written(docs.withColumn(uid, F.monotonically_increasing_id()), "rows")
    narrow = stored.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = checkpointed(fingerprints(narrow, ["uid", "doc_id"]))
    stay = _classes(marked).select(F.col("least.uid").alias(uid)).distinct()
    return stored.join(stay, uid, "left_semi").drop(uid)


def op2(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint in hex and the least doc_id of its near-duplicate class."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
