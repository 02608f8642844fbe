"""Bounded samples of labelled and unlabelled documents to learn from, and columns of scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger.llm.common import TEXT, split_bucket, text_slices, with_text

#: crc32(doc_id) modulo 5 = 0 is held out; the other rows may be learnt from.
PARTS, HELD_OUT = 5, 0


def held_out(doc_id: Column) -> Column:
    return split_bucket(doc_id, PARTS) == HELD_OUT


def _draw(doc_id: Column, share: float, salt: str) -> Column:
    """True for about this share of ids, the same in every run."""
    return F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.lit(1 << 24)) < F.lit(round(min(1.0, share) * (1 << 24)))


def labels_of(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from; null ids and labels teach nothing, of several the largest counts."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label")).where("doc_id is not null and label is not null")
    return rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def _drawn(known: DataFrame, label: int, most: int) -> DataFrame:
    own = known.where(F.col("label") == label)
    return own.where(_draw(F.col("doc_id"), most / max(1, own.count()), f"label {label}"))


def sample(docs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, label) to learn from: at most about ``most`` rows with each label, drawn by a hash of the id."""
    both = _drawn(known, 1, most).unionByName(_drawn(known, 0, most))
    return _learnable(docs).join(F.broadcast(both), "doc_id")  # about 2 * most ids and labels


def sample_unlabelled(docs: DataFrame, known: DataFrame, most: int, unlabelled: int) -> DataFrame:
    """(doc_id, text, label) to learn from positives and unlabelled text: at most about ``most`` rows with label 1, and about
    ``unlabelled`` with null drawn from all rows that may be learnt from. Labels other than 1 are not looked at.
    """
    rows = _learnable(docs)
    drawn = rows.where(_draw(F.col("doc_id"), unlabelled / max(1, rows.select("doc_id").count()), "any")).withColumn("label", F.lit(None).cast("int"))
    return rows.join(F.broadcast(_drawn(known, 1, most)), "doc_id").unionByName(drawn)  # about ``most`` ids and labels


def different(rows: DataFrame) -> DataFrame:
    """Sampled rows with each text and label once, spread over the cores, as Python is to see them next."""
    return rows.dropDuplicates(["text", "label"]).repartition(rows.sparkSession.sparkContext.defaultParallelism)


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], threshold: float, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all, if None), then score and predicted.

    ``score`` takes a list of texts; null texts are empty. What isn't kept doesn't come back from Python.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, TEXT):
            s = score(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return with_text(docs, names).mapInArrow(run, f"{schema}, score double, predicted int")
