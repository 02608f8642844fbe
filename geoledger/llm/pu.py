"""Non-negative positive-unlabelled learning in numpy.

The risk of a classifier f from positives P, unlabelled U and the positives' share prior among U, with the logistic loss:

    prior * mean_P loss(f) + max(0, mean_U loss(-f) - prior * mean_P loss(-f))

The second term estimates the negatives' risk, which cannot be negative; where an estimate falls below zero, the step
goes up it instead of down (Kiryo et al., 2017), which keeps flexible models from fitting the positives alone.

The prior itself comes from P and U too: labelled negatives are used nowhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


#: Standard errors that bound a share, and the positives' share that the prior is read from at least.
SURE, LEAST_ABOVE = 3.0, 0.3


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def risk_gradient(f: np.ndarray, positive: np.ndarray, prior: float, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """The risk's gradient by f, and the risk. positive marks the rows of P; the others are U."""
    p, u = positive, ~positive
    n_p, n_u = max(1, p.sum()), max(1, u.sum())
    loss_neg = np.logaddexp(0, f)
    negatives = loss_neg[u].sum() / n_u - prior * loss_neg[p].sum() / n_p
    up = sigmoid(f)
    g = np.zeros_like(f)
    g[p], g[u] = -prior * up[p] / n_p, up[u] / n_u
    if negatives < -slack:
        g = -g
    else:
        g[p] -= prior * (1 - up[p]) / n_p
    return g, float(prior * np.logaddexp(0, -f[p]).sum() / n_p + max(0.0, negatives))


class Adam:
    def __init__(self, shapes: list[tuple[int, ...]], rate: float):
        self._rate, self._t = rate, 0
        self._m, self._v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]

    def step(self, weights: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self._t += 1
        for w, g, m, v in zip(weights, grads, self._m, self._v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= self._rate * (m / (1 - 0.9**self._t)) / (np.sqrt(v / (1 - 0.999**self._t)) + 1e-8)


def contrast_gradient(f: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The gradient of telling P from U, both of equal weight, with the logistic loss."""
    up = sigmoid(f)
    return np.where(positive, -(1 - up) / max(1, positive.sum()), up / max(1, (~positive).sum()))


def best_bin(of_positives: np.ndarray, of_unlabelled: np.ndarray) -> float:
    """The share of positives among U from scores that tell P from U, of rows the scores weren't learnt from.

    Among rows that score at least c are at most all positives of U; where few others score so high, U's share of such
    rows over P's is the share of positives (best bin estimation, Garg et al., 2021). c is where the upper bound of that
    quotient, by SURE standard errors, is least; at least LEAST_ABOVE of P are above it. P must be drawn like the
    positives of U.
    """
    p, u = np.sort(of_positives), np.sort(of_unlabelled)
    if not len(p) or not len(u):
        return 0.5
    at = np.unique(p)
    q_p, q_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    upper = q_u + SURE / len(u) + SURE * np.sqrt((q_u + SURE / len(u)) / len(u))
    upper = upper / q_p * (1 + SURE * np.sqrt((1 - q_p + 1 / len(p)) / (q_p * len(p))))
    best = int(np.argmin(np.where(q_p >= LEAST_ABOVE, upper, np.inf)))
    return float(q_u[best] / q_p[best])


def estimate_prior(positive: np.ndarray, learn: Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]]) -> float:
    """The share of positives among U: the mean of two estimates, each with scores learnt from the other half of the rows.

    ``learn`` takes the rows of a half and gives a function that scores rows. The rows' order must be settled and without
    meaning. Between 0.001 and 0.999.
    """
    halves = [np.concatenate((np.flatnonzero(positive)[k::2], np.flatnonzero(~positive)[k::2])) for k in (0, 1)]
    found = []
    for own, other in (halves, halves[::-1]):
        score = learn(own)(other)
        found.append(best_bin(score[positive[other]], score[~positive[other]]))
    return float(np.clip(np.mean(found), 1e-3, 1 - 1e-3))


@dataclass(frozen=True)
class Linear:
    """f = bias + the weights of the features that are there."""

    weights: np.ndarray
    bias: float

    def __call__(self, features: list[int]) -> float:
        return self.bias + float(self.weights[features].sum())


def fit_linear(rows: np.ndarray, columns: np.ndarray, width: int, positive: np.ndarray, prior: float | None, steps: int = 400, rate: float = 0.05, shrink: float = 0.004) -> Linear:
    """(rows[k], columns[k]) are the ones of a binary matrix of len(positive) rows. Without a prior P is told from U.

    Every step also moves each weight towards zero by rate * shrink, so that of features that tell the same the general
    ones carry the weight, and those of a single group of copies none.
    """
    n = len(positive)
    weights = [np.zeros(width), np.full(1, 0.0 if prior is None else np.log(prior / (1 - prior)))]
    adam = Adam([(width,), (1,)], rate)
    for _ in range(steps):
        f = weights[1][0] + np.bincount(rows, weights[0][columns], n)
        g = contrast_gradient(f, positive) if prior is None else risk_gradient(f, positive, prior)[0]
        adam.step(weights, [np.bincount(columns, g[rows], width), g.sum(keepdims=True)])
        weights[0] = np.sign(weights[0]) * np.maximum(np.abs(weights[0]) - rate * shrink, 0)
    return Linear(weights[0], float(weights[1][0]))


@dataclass(frozen=True)
class Network:
    """One hidden layer on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2[0]


def fit_network(x: np.ndarray, positive: np.ndarray, prior: float | None, hidden: int = 16, epochs: int = 60, batch: int = 2_000, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Network:
    """Minimise the risk in mini-batches that hold P and U in equal shares of each. Without a prior P is told from U."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.full(1, 0.0 if prior is None else np.log(prior / (1 - prior)))]
    adam = Adam([v.shape for v in w], rate)
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    parts = max(1, -(-len(x) // batch))
    for _ in range(epochs):
        for a, b in zip(np.array_split(rng.permutation(p), parts), np.array_split(rng.permutation(u), parts)):
            if not len(a) or not len(b):
                continue
            rows = np.concatenate((a, b))
            h = np.tanh(z[rows] @ w[0] + w[1])
            f, first = h @ w[2] + w[3][0], np.arange(len(rows)) < len(a)
            g = contrast_gradient(f, first) if prior is None else risk_gradient(f, first, prior)[0]
            back = np.outer(g, w[2]) * (1 - h * h)
            adam.step(w, [z[rows].T @ back + decay * w[0], back.sum(axis=0), h.T @ g + decay * w[2], g.sum(keepdims=True)])
    return Network(mean, scale, *w)
