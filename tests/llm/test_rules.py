"""Quality rules: trees and verdicts against plain computations, row by row."""

import numpy as np
from pyspark.sql import functions as F

from geoledger.llm import langid, rules, simhash
from geoledger.llm.docstats import stats
from tests.llm.test_documents import TEXTS, brute_fingerprint, brute_stats, docs, empty, labelled  # noqa: F401


def walk(trees, x):
    """The score of one row, one node at a time."""
    total, inner = trees.bias, trees.feature.shape[1]
    for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
        k = 0
        while k < inner:
            k = 2 * k + (2 if x[feature[k]] > threshold[k] else 1)
        total += value[k - inner]
    return total


def test_flattened_trees_step_as_nodes_do():
    rng = np.random.default_rng(1)
    x = np.round(rng.random((400, 4)), 2)
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    trees = rules.fit_trees(x, y, np.array([0, 0, 0, 0]), trees=8)
    odd = np.concatenate((x, [[-1e9] * 4, [1e9] * 4, [0.5, 0.7, 0.5, 0.5]]))
    assert np.allclose(trees(odd), [walk(trees, row) for row in odd])
    assert ((trees(x) > 0) == (y > 0)).mean() > 0.97


def test_the_best_split_is_the_best():
    """Against every split of every feature, by the objective itself."""
    rng = np.random.default_rng(2)
    for seed in range(20):
        bins = rng.integers(0, 6, (60, 3))
        g, h = rng.normal(size=60) + bins[:, seed % 3] - 2.5, rng.random(60) + 0.05
        signs = np.array([0, -1, 1])
        value = lambda m: -g[m].sum() / (h[m].sum() + rules.L2)  # noqa: B023, E731
        cost = lambda m, v: g[m].sum() * v + 0.5 * (h[m].sum() + rules.L2) * v * v  # noqa: B023, E731
        best = (1e-6, None)
        everything = np.ones(60, bool)
        for f in range(3):
            for k in range(5):
                left = bins[:, f] <= k
                if min(h[left].sum(), h[~left].sum()) < rules.LEAST_HESSIAN or signs[f] * (value(~left) - value(left)) < 0:
                    continue
                gain = cost(everything, value(everything)) - cost(left, value(left)) - cost(~left, value(~left))
                if gain > best[0] + 1e-12:
                    best = (gain, (f, k))
        found = rules._best_split(bins, g, h, signs, -np.inf, np.inf)
        assert (found is None) == (best[1] is None)
        assert found is None or (abs(found[0] - best[0]) < 1e-9 and found[1:3] == best[1])


def test_verdicts_row_by_row(spark, labelled, docs):  # noqa: F811
    table, labels = labelled
    model = rules.fit(table, labels)
    both = table.select("doc_id", "text").unionByName(docs.where("doc_id is not null").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    for r in rules.judge(both, model).collect():
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = brute_stats(r["text"])
        failed = n_words < 20 or 100 * n_repeat_words > 30 * n_words
        p = 1 / (1 + np.exp(-walk(model, stats(r["text"] or "").features)))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed)
        assert abs(r["probability"] - p) < 1e-9 and r["kept"] == (not failed and p >= rules.THRESHOLD)


def test_letters_and_digits_beyond_the_first_plane():
    plain, far = stats("abc ABC 123").features, stats("\U00010428\U00010429\U0001042a \U00010400\U00010401\U00010402 \U0001d7ce\U0001d7cf\U0001d7d0").features
    assert plain[:12] == far[:12]


def test_very_long_texts(spark):
    """Texts of over a million characters, with and without spaces, against the definitions."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice([*"abcdeé "], 7)) for _ in range(3_000)]
    text = "\n".join(" ".join(rng.choice(words, 12)) for _ in range(13_000))
    solid = "".join(rng.choice([*"abcdefghij"], 1_100_000))
    assert len(text) > 1_050_000
    for t in (text, solid):
        assert simhash.fingerprint(t) == brute_fingerprint(t) % 2**64
        s = stats(t)
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute_stats(t)
        letters = "".join(c.lower() if c.isalpha() else " " for c in t)
        padded = " " + " ".join(letters.split()) + " "
        points = np.array([0 if c == " " else ord(c) for c in padded], np.int64)
        assert (np.sort(langid.grams(t)) == np.sort(points[:-2] << 42 | points[1:-1] << 21 | points[2:])).all()
