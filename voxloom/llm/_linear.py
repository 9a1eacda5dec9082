"""Logistic regression and its calibration, for training sets of bounded size."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Sparse:
    """Rows of (row, column, value) triples, with the two products that fitting needs."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.value, self.shape = row, col, value, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], self.shape[1])


class Dense:
    def __init__(self, x: np.ndarray):
        self.x, self.shape = x, x.shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def back(self, g: np.ndarray) -> np.ndarray:
        return g @ self.x


def fit(x: Sparse | Dense, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 200, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression, by full-batch Adam; `weight` is each row's, 0 leaves a row out."""
    weight = np.ones(len(y)) if weight is None else weight
    total = max(weight.sum(), 1e-9)
    share = np.clip((weight * y).sum() / total, 1e-3, 1 - 1e-3)
    w, b = np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        g = weight * (sigmoid(x.dot(w) + b) - y) / total
        gw, gb = x.back(g) + l2 * w / total, float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate / (1 - 0.9**t)
        w = w - step * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= step * mb / ((vb / (1 - 0.999**t)) ** 0.5 + 1e-9)
    return w, b


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn margins into log-odds, fitted on rows that the margins' model has not seen."""
    scale = max(float(np.abs(margin).mean()), 1e-9)
    w, b = fit(Dense((margin / scale)[:, None]), y, l2=0.1, steps=400)
    return max(float(w[0]), 1e-3) / scale, b


def folds(n: int, k: int) -> np.ndarray:
    """The fold of each of n rows: the same for the same n."""
    return np.random.default_rng(7).permutation(n) % k
