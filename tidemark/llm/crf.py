"""A linear-chain conditional random field in numpy: batches of padded sequences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Weights of features (features x labels), of transitions (from x to) and of first labels."""

    features: np.ndarray
    steps: np.ndarray
    first: np.ndarray


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(emit: np.ndarray, length: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each label, expected transitions, log normaliser) of sequences emit (batch, time, label).

    Sequences must be ordered by falling length, so that a step works on the first rows only.
    """
    n, t, labels = emit.shape
    live = [int(np.searchsorted(-length, -i, "left")) for i in range(t + 1)]
    ahead = np.zeros_like(emit)
    ahead[:, 0] = chain.first + emit[:, 0]
    for i in range(1, t):
        k = live[i]
        ahead[:k, i] = log_sum(ahead[:k, i - 1, :, None] + chain.steps[None], 1) + emit[:k, i]
    total = log_sum(ahead[np.arange(n), length - 1], 1)
    back = np.zeros_like(emit)
    pairs = np.zeros((labels, labels))
    for i in range(t - 2, -1, -1):
        k = live[i + 1]
        if k:
            later = (emit[:k, i + 1] + back[:k, i + 1])[:, None, :] + chain.steps[None]
            back[:k, i] = log_sum(later, 2)
            pairs += np.exp(ahead[:k, i, :, None] + later - total[:k, None, None]).sum(axis=0)
    return np.exp(np.minimum(0, ahead + back - total[:, None, None])), pairs, total


def viterbi(emit: np.ndarray, length: np.ndarray, chain: Chain) -> np.ndarray:
    """The best labels (batch, time) of padded sequences; of equal paths the one with smaller labels from the end."""
    n, t, _ = emit.shape
    best, come = chain.first + emit[:, 0], np.zeros(emit.shape, np.int64)
    for i in range(1, t):
        way = best[:, :, None] + chain.steps[None]
        come[:, i] = way.argmax(axis=1)
        on = (length > i)[:, None]
        best = np.where(on, way.max(axis=1) + emit[:, i], best)
        come[:, i] = np.where(on, come[:, i], np.arange(emit.shape[2])[None])
    path = np.zeros((n, t), np.int64)
    path[:, -1] = best.argmax(axis=1)
    for i in range(t - 1, 0, -1):
        path[:, i - 1] = come[np.arange(n), i, path[:, i]]
    return path


def train(x: np.ndarray, y: np.ndarray, length: np.ndarray, labels: int, rounds: int = 250, rate: float = 0.1, ridge: float = 1e-3) -> Chain:
    """Maximum-likelihood weights by Adam on padded features x (batch, time, feature) and labels y (batch, time)."""
    order = np.argsort(-length, kind="stable")
    x, y, length = x[order], y[order], length[order]
    on = np.arange(x.shape[1])[None] < length[:, None]
    gold = (y[:, :, None] == np.arange(labels)) & on[:, :, None]
    rows = np.ascontiguousarray(x[on])
    gold_features = rows.T @ gold[on].astype(rows.dtype)
    both = on[:, 1:]
    gold_pairs = np.zeros((labels, labels))
    np.add.at(gold_pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    gold_first = gold[:, 0].sum(axis=0)
    chain = Chain(np.zeros((x.shape[2], labels)), np.zeros((labels, labels)), np.zeros(labels))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (chain.features, chain.steps, chain.first)]
    count = on.sum()
    for i in range(1, rounds + 1):
        emit = np.zeros((*x.shape[:2], labels))
        emit[on] = rows @ chain.features.astype(rows.dtype)
        p, pairs, _ = marginals(emit, length, chain)
        slopes = (gold_features - rows.T @ p[on].astype(rows.dtype), gold_pairs - pairs, gold_first - p[:, 0].sum(axis=0))
        for part, slope, (m, v) in zip((chain.features, chain.steps, chain.first), slopes, state, strict=True):
            g = slope / count - ridge * part
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            part += rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return chain


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression with a constant in front, by damped Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))
