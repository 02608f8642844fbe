"""Quality by non-negative positive-unlabelled learning: a small network on a text's statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.llm.common import table, text_slices
from geoledger.llm.docstats import FEATURES, stats
from geoledger.llm.labelled import different, held_out, labels_of, sample_unlabelled, scored
from geoledger.llm.pu import Network, estimate_prior, fit_network, sigmoid

#: Trusted rows, and unlabelled ones, that a fit takes at most (about).
MOST, MOST_UNLABELLED = 10_000, 10_000
THRESHOLD = 0.3


class Model:
    def __init__(self, network: Network | None):
        self._network = network

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self._network is None:
            return np.full(len(texts), 1.0)
        return sigmoid(self._network(np.array([stats(t).features for t in texts])))


def features(rows: DataFrame) -> DataFrame:
    """(label, features) of each sampled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            found = [list(stats(t).features) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["label", "features"])

    return rows.select("text", "label").mapInArrow(run, "label int, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Learn from rows that are not held out: quality 1 as trusted positives, and unlabelled web text.

    The class prior is estimated from these two, and labels other than 1 are not looked at. At most about ``most`` trusted
    and ``most_unlabelled`` other rows are taken, of each only its statistics. Without a positive or without any other row
    nothing is known against a text, and all score 1.
    """
    rows = sample_unlabelled(docs, labels_of(labels, "quality"), most, most_unlabelled)
    got = features(different(rows)).toPandas()
    positive = (got["label"] == 1).to_numpy()
    if not positive.any() or positive.all():
        return Model(None)
    x = np.array(got["features"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, positive))  # rows come in any order
    order = order[np.random.default_rng(3).permutation(len(order))]
    x, positive = x[order], positive[order]
    prior = estimate_prior(positive, lambda half: lambda rest: fit_network(x[half], positive[half], None)(x[rest]))
    return Model(fit_network(x, positive, prior))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (of which only the columns ``keep``) with score (0 to 1) and predicted; a null text is empty. One row for each."""
    return scored(docs, model, THRESHOLD, keep)


def op6(spark, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
