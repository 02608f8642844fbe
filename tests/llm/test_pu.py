"""Positive-unlabelled learning: gradients, the prior, and the two classifiers against plain computations."""

import numpy as np
import pytest
import xxhash

from geoledger.llm import pu, quality, toxicity
from geoledger.llm.docstats import stats
from tests.llm.test_documents import LABELS, SCHEMA, empty, labelled, prose  # noqa: F401


def brute_risk(f, positive, prior):
    """The non-negative risk, one row at a time."""
    loss = lambda z: np.log1p(np.exp(-z))
    p, u = [x for x, is_p in zip(f, positive) if is_p], [x for x, is_p in zip(f, positive) if not is_p]
    negative = sum(loss(-x) for x in u) / len(u) - prior * sum(loss(-x) for x in p) / len(p)
    return prior * sum(loss(x) for x in p) / len(p) + max(0.0, negative), negative


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_gradient_is_the_risk_s(shift):
    rng = np.random.default_rng(1)
    positive = np.arange(40) < 12
    f = rng.normal(size=40) + shift * positive - shift * ~positive
    prior = 0.3 if shift == 0 else 0.9
    g, risk = pu.risk_gradient(f, positive, prior)
    want, negative = brute_risk(f, positive, prior)
    assert abs(risk - want) < 1e-12 and (negative > 0) == (shift == 0)
    part = (lambda v: brute_risk(v, positive, prior)[0]) if negative > 0 else (lambda v: -brute_risk(v, positive, prior)[1])
    numeric = [(part(f + 1e-6 * e) - part(f - 1e-6 * e)) / 2e-6 for e in np.eye(40)]
    assert np.allclose(g, numeric, atol=1e-6)


def test_contrast_gradient_is_its_loss_s():
    rng = np.random.default_rng(2)
    positive, f = np.arange(20) < 7, rng.normal(size=20)
    loss = lambda v: np.logaddexp(0, -v[positive]).mean() + np.logaddexp(0, v[~positive]).mean()
    numeric = [(loss(f + 1e-6 * e) - loss(f - 1e-6 * e)) / 2e-6 for e in np.eye(20)]
    assert np.allclose(pu.contrast_gradient(f, positive), numeric, atol=1e-6)


@pytest.mark.parametrize("prior", [0.05, 0.12, 0.5, 0.86])
def test_prior_of_mixtures(prior):
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(2, 1, 2_000), rng.normal(np.where(rng.random(6_000) < prior, 2, -2), 1)))[:, None]
    positive = np.arange(8_000) < 2_000
    got = pu.estimate_prior(positive, lambda half: lambda rest: x[rest, 0])
    assert abs(got - prior) < 0.15 * prior + 0.01


def test_prior_of_odd_scores():
    assert pu.best_bin(np.zeros(0), np.ones(3)) == 0.5
    assert pu.best_bin(np.ones(10), np.ones(10)) == 1.0 and pu.best_bin(np.ones(10), np.zeros(10)) == 0.0


def scores(model, rows):
    return model([r["text"] or "" for r in rows])


def test_labelled_negatives_teach_nothing(spark, labelled):  # noqa: F811
    """With positives only, and with half of the negatives gone or wrong, the models are the same."""
    table, labels = labelled
    rows = table.orderBy("doc_id").limit(200).collect()
    for module, name in ((toxicity, "toxic"), (quality, "quality")):
        whole = scores(module.fit(table, labels), rows)
        assert np.allclose(scores(module.fit(table, labels.where(f"{name} = 1")), rows), whole, atol=1e-9)


def brute_toxicity(model, text):
    """The score from the definition of the features."""

    def of(token):
        word = token.strip(toxicity._NOT_LETTERS)
        runs = {word[i : i + 5] for i in range(len(word) - 4)}
        if len(word) > toxicity.WORD_LETTERS:
            return {f"~{r}" for r in runs}
        return ({f"={word}"} | {f"^{word[:k]}" for k in (4, 5, 6) if len(word) > k} | runs) if word else set()

    counts = {}
    for token in set(text.lower().split()):
        for h in {xxhash.xxh32_intdigest(p) - 2**31 for p in of(token)}:
            counts[h] = counts.get(h, 0) + 1
    there = set(counts) | {h ^ 0x4F6CDD1D for h, n in counts.items() if n > 1}
    weight = dict(zip((int(f) for f in model._at), model._weights))
    return 1 / (1 + np.exp(-(model._bias + sum(weight.get(h, 0.0) for h in there))))


def test_scores_against_their_definitions(spark, labelled):  # noqa: F811
    table, labels = labelled
    rows = table.orderBy("doc_id").limit(60).collect() + [{"text": t} for t in ("", None, "x", "a" * 500, "Vilething! vilething. " * 3, "ok " * 2_000)]
    toxic = toxicity.fit(table, labels)
    assert np.allclose(scores(toxic, rows), [brute_toxicity(toxic, r["text"] or "") for r in rows])
    good = quality.fit(table, labels)
    n = good._network
    want = [1 / (1 + np.exp(-(np.tanh(np.clip((np.array(stats(r["text"] or "").features) - n.mean) / n.scale, -8, 8) @ n.w1 + n.b1) @ n.w2 + n.b2[0]))) for r in rows]
    assert np.allclose(scores(good, rows), want)


def test_toxic_text_without_spaces(labelled):  # noqa: F811
    """A text of 100,000 letters without a space is found by what is glued into it, and a clean one is left alone."""
    table, labels = labelled
    model = toxicity.fit(table, labels)
    clean = "".join("".join(prose(k, 50).lower().split()) for k in range(1_000, 1_500))[:100_000]
    planted = clean[:50_000] + "youvilethinggrumblastgrumblax" + clean[50_000:]
    assert len(clean) == 100_000 and model([planted])[0] > 0.9 and model([clean])[0] < 0.5


def test_near_copies_in_a_sample():
    rng = np.random.default_rng(5)
    marks = rng.integers(0, 2**32, (300, toxicity.MINHASHES)).astype(np.uint32)
    marks[200:] = marks[:100]
    marks[200:, 16:] += 1  # half the same
    marks[150:200, :17] = marks[:50, :17]
    want, kept = [], []
    for k, m in enumerate(marks):
        if all(2 * (m == marks[j]).sum() < toxicity.MINHASHES for j in kept):
            kept.append(k)
    want = np.isin(np.arange(300), kept)
    assert (toxicity.one_of_each(marks) == want).all() and want.sum() == 150
