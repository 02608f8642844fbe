"""The corpus pipeline: each stage keeps what its operator keeps, and the last packs it into training sequences."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.llm import nearcopies, packing, quality, rules
from geoledger.llm.common import release, settled, small_batches, table


def _kept(docs: DataFrame, judged, new: list[str], condition: str) -> DataFrame:
    """The rows of docs for which ``condition`` holds on the columns ``new`` that ``judged`` adds; own columns stay as they are."""
    taken = {c.lower() for c in (*docs.columns, *new)}
    free = (f"own {k}" for k in range(10**6) if f"own {k}" not in taken)
    aside = {c: next(free) for c in docs.columns if c.lower() in {n.lower() for n in new}}
    out = judged(docs.withColumnsRenamed(aside)).where(condition).drop(*new)
    return out.withColumnsRenamed({v: k for k, v in aside.items()}).select([F.col(f"`{c}`") for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier doesn't reject."""
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d: quality.score(d, model), ["score", "predicted"], "predicted = 1")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules and trees keep. Trees learn from the labelled documents of the table: the stage before leaves hardly a bad one."""
    small_batches(spark)
    model = rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d: rules.judge(d, model), rules.ADDED, "kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    small_batches(spark)
    return nearcopies.representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of every document is in the packed sequences."""
    small_batches(spark)
    return packing.pieces(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("packing", pack),
]

#: Classifiers and packing aren't expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(spark, partial(stage, spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
