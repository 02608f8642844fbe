"""Quality rules by gradient-boosted trees over document statistics.

Trees are grown on binned columns with the logistic loss. For chosen features the output may only fall as the feature
rises: a split that would break that is not taken, and both sides of one that is taken are bounded by its middle. The
fitted trees are flattened into arrays of nodes, in which all documents and all trees step down one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoledger.llm.common import TEXT, table, text_slices, with_text
from geoledger.llm.docstats import FEATURES, stats
from geoledger.llm.labelled import different, labels_of, sample
from geoledger.llm.pu import sigmoid
from geoledger.llm.quality import features

#: Rows of each label that a fit takes at most (about).
MOST = 10_000
#: A document is kept if its probability of quality reaches this.
THRESHOLD = 0.5
TREES, DEPTH, RATE, BINS, LEAST_HESSIAN, L2 = 60, 3, 0.2, 64, 2.0, 1.0


@dataclass(frozen=True)
class Trees:
    """Flattened trees. Node k of a tree has children 2k + 1 and 2k + 2; a leaf passes rows on to its left child."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves at the lowest level)
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        inner = self.feature.shape[1]
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.bias + self.value[tree, at - inner].sum(axis=1)


def _best_split(bins: np.ndarray, g: np.ndarray, h: np.ndarray, signs: np.ndarray, low: float, high: float) -> tuple | None:
    """(gain, feature, last bin on the left, left value, right value) of the best split that the signs allow."""
    best = None
    total_g, total_h = g.sum(), h.sum()
    for f in range(bins.shape[1]):
        gl = np.cumsum(np.bincount(bins[:, f], g, BINS))[:-1]
        hl = np.cumsum(np.bincount(bins[:, f], h, BINS))[:-1]
        gr, hr = total_g - gl, total_h - hl
        left, right = np.clip(-gl / (hl + L2), low, high), np.clip(-gr / (hr + L2), low, high)
        own = np.clip(-total_g / (total_h + L2), low, high)
        worth = lambda v, gs, hs: -(gs * v + 0.5 * (hs + L2) * v * v)
        gain = worth(left, gl, hl) + worth(right, gr, hr) - worth(own, total_g, total_h)
        gain[(hl < LEAST_HESSIAN) | (hr < LEAST_HESSIAN) | (signs[f] * (right - left) < 0)] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), f, k, float(left[k]), float(right[k]))
    return best


def _grow(bins: np.ndarray, edges: np.ndarray, g: np.ndarray, h: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inner = 2**DEPTH - 1
    feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**DEPTH)
    todo = [(0, np.arange(len(g)), -np.inf, np.inf)]
    while todo:
        k, rows, low, high = todo.pop()
        if k >= inner:
            value[k - inner] = np.clip(-g[rows].sum() / (h[rows].sum() + L2), low, high) if len(rows) else np.clip(0.0, low, high)
            continue
        found = _best_split(bins[rows], g[rows], h[rows], signs, low, high) if len(rows) else None
        if not found:
            todo += [(2 * k + 1, rows, low, high), (2 * k + 2, rows[:0], low, high)]
            continue
        _, f, last, left, right = found
        feature[k], threshold[k] = f, edges[f, last]
        goes_right, middle = bins[rows, f] > last, (left + right) / 2
        bounds = [(low, high), (low, high)]
        if signs[f] < 0:
            bounds = [(middle, high), (low, middle)]
        elif signs[f] > 0:
            bounds = [(low, middle), (middle, high)]
        todo += [(2 * k + 1, rows[~goes_right], *bounds[0]), (2 * k + 2, rows[goes_right], *bounds[1])]
    return feature, threshold, value


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = TREES) -> Trees:
    """Boost with the logistic loss. signs[f] is -1 (the output may not rise with feature f), 1 (nor fall) or 0."""
    edges = np.stack([np.quantile(x[:, f], np.arange(1, BINS) / BINS) for f in range(x.shape[1])])
    bins = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    f, grown = np.full(len(y), bias), []
    for _ in range(trees):
        p = sigmoid(f)
        feature, threshold, value = _grow(bins, edges, p - y, np.maximum(p * (1 - p), 1e-9), signs)
        tree = Trees(feature[None], threshold[None], RATE * value[None], 0.0)
        f += tree(x)
        grown.append(tree)
    return Trees(*(np.concatenate([getattr(t, n) for t in grown]) for n in ("feature", "threshold", "value")), bias)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Trees | None:
    """Learn quality from labelled rows that are not held out, about ``most`` of each label; copies of a text count once.

    None if both labels aren't there: then nothing but the base rules rejects a document.
    """
    rows = sample(docs, labels_of(labels, "quality"), most)
    got = features(different(rows)).toPandas()
    if got["label"].nunique() < 2:
        return None
    x, y = np.array(got["features"].tolist()).reshape(-1, len(FEATURES)), got["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # rows come in any order
    return fit_trees(x[order], y[order], np.array(list(FEATURES.values())))


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
#: The columns that judge() adds.
ADDED = [c.split()[0] for c in _COLUMNS.split(", ")]


def judge(docs: DataFrame, model: Trees | None, keep: list[str] | None = None) -> DataFrame:
    """docs (of which only the columns ``keep``) with the statistics, base_failed, the trees' probability of quality, and kept. A null text has no words.

    Columns of docs with one of these names are replaced. One row for each input row.
    """
    new = ADDED
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, TEXT):
            found = [stats(t) for t in texts]
            p = np.ones(len(found)) if model is None else sigmoid(model(np.array([s.features for s in found])))
            failed = np.array([s.base_failed for s in found])
            counts = [pa.array([getattr(s, n) for s in found], pa.int64()) for n in new[:5]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts, pa.array(failed), pa.array(p), pa.array(~failed & (p >= THRESHOLD))], [*names, *new])

    return with_text(docs, names).mapInArrow(run, f"{schema}, {_COLUMNS}")


def op9(spark, sf_dir: str) -> DataFrame:
    """The statistics of every document, and whether rules and trees keep it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
