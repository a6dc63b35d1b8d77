"""Logistic regression on a bounded sample, for models that tasks apply to everything."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Logistic:
    """P(1) = sigmoid(x @ weight + bias)."""

    weight: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weight + self.bias)


def fit(x: np.ndarray, y: np.ndarray, *, penalty: float = 1.0, rounds: int = 200) -> Logistic:
    """L2-penalised fit by Nesterov's accelerated gradient; deterministic.

    With one class only (or no rows) the model is that class's smoothed rate.
    """
    n, m = x.shape
    rate = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(rate / (1 - rate)))
    if n == 0 or y.min() == y.max():
        return Logistic(np.zeros(m), bias if n else -30.0)
    # The gradient's Lipschitz bound, from the largest singular value by power iteration.
    v = np.ones(m + 1) / np.sqrt(m + 1)
    for _ in range(20):
        s = x @ v[:-1].astype(x.dtype) + v[-1]
        v = np.append(x.T @ s.astype(x.dtype), s.sum())
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (0.25 * norm + penalty)
    w = np.append(np.zeros(m), bias)
    ahead, before = w.copy(), w
    for k in range(rounds):
        p = sigmoid(x @ ahead[:-1].astype(x.dtype) + ahead[-1]) - y
        w = ahead - step * np.append(x.T @ p.astype(x.dtype) + penalty * ahead[:-1], p.sum())
        ahead = w + k / (k + 3) * (w - before)
        before = w
    return Logistic(w[:-1], float(w[-1]))


def folds(keys: np.ndarray, k: int) -> np.ndarray:
    """A fold for each row, by its key alone."""
    return (np.asarray(keys).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(k)


def chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, k: int, **options) -> list[Logistic]:
    """A model for each column of ``labels``; each also takes the probabilities of those before it.

    For training these probabilities are out of fold: a row's come from models
    that were fitted without its fold.  The models returned are fitted on all rows.
    """
    models, inputs = [], x
    for c in range(labels.shape[1]):
        y = labels[:, c]
        models.append(fit(inputs, y, **options))
        if c + 1 < labels.shape[1]:
            out = np.zeros(len(y))
            for f in range(k):
                held = fold == f
                out[held] = fit(inputs[~held], y[~held], **options)(inputs[held])
            inputs = np.column_stack([inputs, out.astype(inputs.dtype)])
    return models


def apply_chain(models: list[Logistic], x: np.ndarray) -> np.ndarray:
    """Probabilities [rows, models]."""
    out = np.zeros((len(x), len(models)))
    m = x.shape[1]
    for c, model in enumerate(models):
        out[:, c] = sigmoid(x @ model.weight[:m] + out[:, :c] @ model.weight[m:] + model.bias)
    return out
