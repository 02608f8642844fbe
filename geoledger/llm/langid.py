"""Language identification by hyperdimensional profiles.

Every letter, of any script, has a random vector of +1 and -1 of its own. A letter three-gram is bound from its letters' vectors, permuted by their
place and multiplied; a text's profile bundles (adds) its three-grams, and a language's prototype bundles its texts. A text
is compared with the prototypes by cosine, after what all prototypes have in common is taken away from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.llm.common import TEXT, split_bucket, table, text_slices, with_text

DIMENSIONS = 1_024
#: Documents of each language that its prototype is learnt from, at most (about); and languages, the most frequent ones.
PER_LANGUAGE, MOST_LANGUAGES = 5_000, 1_000
#: Cosines' differences are so sharpened to a score.
SHARPNESS = 40.0
UNKNOWN = "und"
#: A three-gram is three code points of so many bits; 0 is a gap.
_BITS = 21
#: Different three-grams whose vectors are made at once.
_BLOCK = 8_192


@cache
def _letters() -> np.ndarray:
    """For every code point the lower-cased one if it is a letter, and 0 if not."""
    return np.fromiter((ord(c.lower()[:1]) if c.isalpha() else 0 for c in map(chr, range(0x110000))), np.int32, 0x110000)


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The +1 and -1 of each code point: bits of a mixed number of the point and the place, the same everywhere."""
    words = -(-dimensions // 64)
    # The multipliers and shifts of the splitmix64 generator.
    x = (points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(1, words + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(points), -1), axis=1)[:, :dimensions]
    return 2 * bits.astype(np.int8) - 1


def gram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bound vectors of three-grams: the first letter's permuted twice, the second's once, the third's as it is."""
    points, at = np.unique(np.stack([grams >> 2 * _BITS, grams >> _BITS & (1 << _BITS) - 1, grams & (1 << _BITS) - 1]), return_inverse=True)
    vectors = letter_vectors(points, dimensions)
    a, b, c = at.reshape(3, -1)
    return (np.roll(vectors, 2, axis=1)[a] * np.roll(vectors, 1, axis=1)[b] * vectors[c]).astype(np.float32)


def grams(text: str) -> np.ndarray:
    """Numbers of the three-grams of a text, over letters and single gaps; empty without a letter."""
    bind = lambda a, b, c: a << 2 * _BITS | b << _BITS | c
    found, last = [], np.zeros(1, np.int64)
    for at in range(0, len(text), 1 << 20):
        points = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "replace"), "<u4")
        letters = np.concatenate((last, _letters()[points].astype(np.int64)))
        kept = np.concatenate((letters[:1], letters[1:][(letters[1:] > 0) | (letters[:-1] > 0)]))
        found.append(bind(kept[:-2], kept[1:-1], kept[2:]))
        last = kept[-2:]
    if len(last) > 1 and last[-1]:
        found.append(bind(last[-2:-1], last[-1:], np.zeros(1, np.int64)))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def bundle(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(profiles, whether the text has a letter) of several texts. Vectors are made for a block of three-grams at a time."""
    each = [grams(t) for t in texts]
    sizes = np.array([len(g) for g in each], np.int64)
    different, at = np.unique(np.concatenate([np.zeros(0, np.int64), *each]), return_inverse=True)
    of, profiles = np.repeat(np.arange(len(texts)), sizes), np.zeros((len(texts), dimensions), np.float32)
    if len(different) > _BLOCK:
        order = np.argsort(at, kind="stable")
        at, of = at[order], of[order]
    for low in range(0, len(different), _BLOCK):
        part = slice(None) if len(different) <= _BLOCK else slice(*np.searchsorted(at, (low, low + _BLOCK)))
        vectors = gram_vectors(different[low : low + _BLOCK], dimensions)
        width, first = len(vectors), of[part].min()
        rows = of[part].max() - first + 1
        counts = np.bincount((of[part] - first) * width + at[part] - low, minlength=rows * width).reshape(rows, width)
        profiles[first : first + rows] += counts.astype(np.float32) @ vectors
    return profiles, sizes > 0


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from text and lang of docs (rows to learn from; null langs teach nothing).

    About ``per_language`` documents of each of the MOST_LANGUAGES most frequent languages are drawn by a hash of the id;
    each counts by the direction of its profile. Sums are of integers, so their order doesn't matter.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    tally = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not tally:
        return [], np.zeros((0, dimensions))
    shares = F.create_map(*(F.lit(v) for r in tally for v in (r["lang"], round(min(1.0, per_language / r["count"]) * (1 << 24)))))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 24)) < F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch, texts in text_slices(batches):
            profiles, _ = bundle(texts, dimensions)
            whole = np.rint(_unit(profiles) * 2**20).astype(np.int64)
            langs = np.array(batch.column(2).to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + whole[langs == lang].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], ["lang", "vector"])

    parts = drawn.mapInArrow(run, "lang string, vector array<bigint>").select("lang", F.posexplode("vector").alias("at", "v"))
    sums = parts.groupBy("lang", "at").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "v")))["v"].alias("vector"))
    got = sorted((r["lang"], r["vector"]) for r in sums.collect())  # one vector for each language
    return [g[0] for g in got], np.array([g[1] for g in got], float).reshape(-1, dimensions)


def centred(prototypes: np.ndarray) -> np.ndarray:
    """Unit prototypes without their mean, unit again; a single one stays as it is."""
    unit = _unit(prototypes)
    return unit if len(unit) < 2 else _unit(unit - unit.mean(axis=0))


def identify(docs: DataFrame, languages: list[str], prototypes: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """docs (of which only the columns ``keep``) with lang_pred and score (0 to 1: the prediction's share when cosines are sharpened and shared out).

    docs must have text; its lang is not looked at. A null text or one without a letter is ``und`` with score 0, and so is
    every text if no language was learnt. Of equally near languages the first in alphabetical order is said. One row for
    each input row.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    against, dimensions = centred(prototypes).T.astype(np.float32), prototypes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, TEXT):
            profiles, lettered = bundle(texts, dimensions)
            if not languages:
                lettered[:] = False
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            else:
                cosines = (_unit(profiles) @ against).astype(float)
                best = cosines.argmax(axis=1)
                score = 1 / np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True))).sum(axis=1)
            said = [languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said, pa.string()), pa.array(np.where(lettered, score, 0.0))], [*names, "lang_pred", "score"])

    return with_text(docs, names).mapInArrow(run, f"{schema}, lang_pred string, score double")


def op3(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = split_bucket(F.col("doc_id"), 3) == 1
    languages, prototypes = fit(docs.where(~held))
    out = identify(docs.select("doc_id", "text"), languages, prototypes, ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
