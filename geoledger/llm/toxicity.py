"""Toxicity by non-negative positive-unlabelled learning: a linear model of the words and word pieces in a text.

A feature is there or not, so one abusive word counts the same in a short and in a long text; that two different words
have it is a feature of its own. Pieces (beginnings and five-letter runs of words) carry over to inflected forms that no
training text has.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.llm.common import checkpointed, release, table, text_slices
from geoledger.llm.labelled import different, held_out, labels_of, sample_unlabelled, scored
from geoledger.llm.pu import estimate_prior, fit_linear, sigmoid

#: Confirmed rows, and unlabelled ones, that a fit takes at most (about).
MOST, MOST_UNLABELLED = 2_000, 4_000
#: Features kept; they must be in so many confirmed texts' views, and in this share of them.
WIDTH, LEAST, LEAST_SHARE = 2_048, 3, 0.004
#: And more frequent among the confirmed by so many standard deviations.
LEAST_Z = 4.5
#: Sampled texts that share half of so many minhashes are near copies.
MINHASHES = 32
THRESHOLD = 0.5
#: A longer token is text without spaces.
WORD_LETTERS = 40
_CACHE = 200_000
_NOT_LETTERS = "0123456789_.,;:!?'\"()[]{}<>|#*$%&+-=/\\~^`@«»„“”‘’…–—¿¡"


def _runs(word: str) -> Iterator[str]:
    """Five-letter runs, of which a word of any length has all."""
    return (word[i : i + 5] for i in range(len(word) - 4))


def pieces(token: str) -> Iterable[str]:
    """Features of one token, some twice: its word, the word's beginnings, and its runs of five letters.

    A token of more letters than WORD_LETTERS is text without spaces: it has the runs only, which tell less there, as many
    lie across words; so they are features apart.
    """
    word = token.strip(_NOT_LETTERS)
    if len(word) > WORD_LETTERS:
        return (f"~{run}" for run in _runs(word))
    if not word:
        return ()
    return [f"={word}", *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) > k), *_runs(word)]


def hashed(token: str) -> set[int] | list[int]:
    """The different features of one token as signed 32-bit numbers; a long one's pieces are numbers from the start."""
    digest = xxhash.xxh32_intdigest
    if len(token) <= WORD_LETTERS:
        return {digest(p) - 2**31 for p in pieces(token)}
    return np.unique(np.fromiter((digest(p) - 2**31 for p in pieces(token)), np.int32)).tolist()


def several(hash_):
    """The feature that two or more different tokens have this one."""
    return hash_ ^ 0x4F6CDD1D


def text_features(tokens: set[str]) -> np.ndarray:
    """The different features of a text's tokens, ascending."""
    flat = array("i")
    for token in tokens:
        flat.extend(hashed(token))
    found, counts = np.unique(np.array(flat, np.int32), return_counts=True)
    return np.union1d(found, several(found[counts > 1]))


def tokens(text: str) -> set[str]:
    return set(text.lower().split())


def unspaced(text: str) -> set[str]:
    """The text as the one token that it is without white space."""
    return {"".join(text.lower().split())}


class Model:
    """Scores texts; what each token adds is remembered."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self._at = {int(f): k for k, f in enumerate(features)}
        self._wanted = {*self._at, *map(several, self._at)}
        self._weights, self._bias, self._known = weights, bias, {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def _of(self, token: str) -> tuple[int, ...]:
        found = self._known.get(token)
        if found is None:
            found = tuple(h for h in hashed(token) if h in self._wanted)
            if len(token) <= 2 * WORD_LETTERS:
                if len(self._known) >= _CACHE:
                    self._known.clear()
                self._known[token] = found
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            counts = Counter(chain.from_iterable(map(self._of, tokens(text))))
            there = {self._at.get(h) for h in counts} | {self._at.get(several(h)) for h, n in counts.items() if n > 1}
            out[i] = self._bias + self._weights[sorted(there - {None})].sum()
        return sigmoid(out)


@cache
def _salts() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    return rng.integers(1, 2**32, MINHASHES, np.uint64) | np.uint64(1), rng.integers(0, 2**32, MINHASHES, np.uint64)


def minhashes(text: str) -> np.ndarray:
    """Minhashes of a text's pairs of neighbouring words; zeros without a word."""
    words = text.lower().split()
    pairs = {xxhash.xxh32_intdigest(f"{a} {b}") for a, b in zip(words, [*words[1:], ""][: max(1, len(words) - 1)])}
    if not pairs:
        return np.zeros(MINHASHES, np.uint32)
    a, b = _salts()
    flat = np.fromiter(pairs, np.uint64, len(pairs))
    return np.array([(flat * x + y).astype(np.uint32).min() for x, y in zip(a, b)])


def one_of_each(marks: np.ndarray) -> np.ndarray:
    """Which rows of minhashes to keep so that of near copies one stays: the first of those that share half of them.

    A row is compared with the kept ones that share a minhash at the same place, and with no others.
    """
    kept: dict[tuple[int, int], list[int]] = {}
    keep = np.zeros(len(marks), bool)
    for k, mark in enumerate(marks.tolist()):
        shared = Counter(chain.from_iterable(kept.get(place, ()) for place in enumerate(mark)))
        if 2 * max(shared.values(), default=0) < MINHASHES:
            keep[k] = True
            for place in enumerate(mark):
                kept.setdefault(place, []).append(k)
    return keep


def _features(rows: DataFrame) -> DataFrame:
    """(key, label, features, marks): the hashed features of each sampled text, once as it is and once without white space, and its minhashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            for view in (tokens, unspaced):
                found = pa.array([text_features(view(t)) for t in texts], pa.list_(pa.int32()))
                marks = pa.array([minhashes(t).tobytes() if view is tokens else None for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), found, marks], ["key", "label", "features", "marks"])

    return rows.select("text", F.xxhash64("text").alias("key"), "label").mapInArrow(run, "key long, label int, features array<int>, marks binary")


def _selected(rows: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """The features that positives have most significantly more often than the others, WIDTH at most, ascending."""
    counts = lambda side: side.select(F.explode("features").alias("f")).groupBy("f").count()
    in_p = counts(rows.where("label = 1")).where(F.col("count") >= max(LEAST, LEAST_SHARE * n_p)).withColumnRenamed("count", "p")
    in_u = counts(rows.where("label is null")).withColumnRenamed("count", "u")
    both = in_p.join(in_u, "f", "left").select("f", "p", F.coalesce("u", F.lit(0)).alias("u"))
    both = both.withColumn("mean", (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2))
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(F.col("mean") * (1 - F.col("mean")) * (1 / n_p + 1 / n_u))
    best = both.select("f", z.alias("z")).where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "f").limit(WIDTH)
    return np.sort(np.array([r["f"] for r in best.collect()], np.int32))  # WIDTH numbers at most


def _narrowed(rows: DataFrame, names: np.ndarray) -> pa.Table:
    """(key, label, as_is, columns) of the rows: which of the selected features each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            place = np.minimum(np.searchsorted(names, flat), max(0, len(names) - 1))
            there = names[place] == flat if len(names) else np.zeros(len(flat), bool)
            ends = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[there], minlength=len(sizes)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[there], pa.int32()))], ["key", "label", "as_is", "columns"])

    return rows.select("key", "label", "features", F.col("marks").isNotNull().alias("as_is")).mapInArrow(run, "key long, label int, as_is boolean, columns array<int>").toArrow().combine_chunks()


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Learn from rows that are not held out: label 1 as positives, and unlabelled text.

    The class prior is estimated from these two, and labels other than 1 are not looked at. At most about ``most`` positives
    and ``most_unlabelled`` others are taken; of copies and near copies among them one counts. Their features are counted in
    Spark, and only the columns of selected ones come to the driver. Every text is learnt from twice, as it is and without
    white space. Without a positive or without any other row nothing is toxic, and all scores are 0.
    """
    rows = sample_unlabelled(docs, labels_of(labels, "toxic"), most, most_unlabelled)
    rows = checkpointed(_features(different(rows)))
    got = rows.where("marks is not null").select("key", "label", "marks").toArrow().combine_chunks()  # MINHASHES numbers a row
    positive, keys = np.array(got.column("label").to_pylist(), object) == 1, got.column("key").to_numpy()
    if not positive.any() or positive.all():
        return Model(np.zeros(0, np.int32), np.zeros(0), -60.0)
    marks = np.frombuffer(b"".join(got.column("marks").to_pylist()), np.uint32).reshape(-1, MINHASHES)
    kept = []
    for side, label in ((positive, 1), (~positive, None)):
        order = np.argsort(keys[side], kind="stable")  # rows come in any order
        kept += [(int(k), label) for k in keys[side][order][one_of_each(marks[side][order])]]
    chosen = docs.sparkSession.createDataFrame(kept, "key long, kept int")  # a row for each sampled text
    own = rows.join(F.broadcast(chosen), "key").where(F.col("label").eqNullSafe(F.col("kept")))
    n_p = sum(label == 1 for _, label in kept)
    names = _selected(own, 2 * n_p, 2 * (len(kept) - n_p))
    got = _narrowed(own, names)
    release(rows)
    order = np.lexsort((got.column("key").to_numpy(), ~np.array(got.column("as_is").to_pylist(), bool)))  # texts as they are come first
    got = got.take(pa.array(order)).combine_chunks()
    positive, lists = np.array(got.column("label").to_pylist(), object) == 1, got.column("columns").combine_chunks()
    columns, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(positive)), lists.value_lengths().to_numpy())
    n = len(kept)

    def learn(half: np.ndarray):
        mine = np.full(len(positive), -1)
        mine[half] = np.arange(len(half))
        inside = mine[of] >= 0
        model = fit_linear(mine[of[inside]], columns[inside], len(names), positive[half], None)
        return lambda rest: np.bincount(of, model.weights[columns], len(positive))[rest]

    model = fit_linear(of, columns, len(names), positive, estimate_prior(positive[:n], learn))
    return Model(names, model.weights, model.bias)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (of which only the columns ``keep``) with score (0 to 1) and predicted; a null text is empty. One row for each."""
    return scored(docs, model, THRESHOLD, keep)


def op5(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
