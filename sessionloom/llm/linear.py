"""Small linear models fitted on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Gradient steps with running moments."""

    def __init__(self, size, rate: float = 0.05):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient ** 2 - self.v)
        return self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)


class Rows:
    """Sparse binary rows: ``index`` holds the columns of all rows back to back."""

    def __init__(self, rows: list[np.ndarray], columns: int):
        self.columns = columns
        self.index = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, dtype=np.int64)
        self.owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.count = len(rows)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=weights[self.index], minlength=self.count)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=values[self.owner], minlength=self.columns)


def fit_soft_logistic(rows: Rows, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on soft targets with row weights."""
    share = weight / weight.sum()
    w, b = np.zeros(rows.columns), 0.0
    adam = Adam(rows.columns + 1)
    for _ in range(steps):
        error = (sigmoid(rows.times(w) + b) - target) * share
        move = adam.step(np.append(rows.back(error) + ridge * w, error.sum()))
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit_scale(margin: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 500) -> tuple[float, float]:
    """Slope (above 0) and shift that turn margins into probabilities of the labels."""
    share = weight / weight.sum()
    spread = max(float(np.std(margin)), 1e-6)
    slope, shift = 1.0, 0.0
    adam = Adam(2)
    z = margin / spread
    for _ in range(steps):
        error = (sigmoid(slope * z + shift) - label) * share
        move = adam.step(np.array([(error * z).sum() + 1e-4 * slope, error.sum()]))
        slope, shift = max(1e-3, slope - move[0]), shift - move[1]
    return slope / spread, shift


def fit_softmax(x: np.ndarray, label: np.ndarray, classes: int, weight: np.ndarray, ridge: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights (columns + 1, classes) of a multinomial logistic regression; the last row is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    w = np.zeros((x.shape[1], classes))
    adam = Adam(w.shape)
    goal = np.eye(classes)[label]
    share = (weight / weight.sum())[:, None]
    for _ in range(steps):
        error = (softmax(x @ w.astype(x.dtype)) - goal) * share
        w -= adam.step(x.T @ error.astype(x.dtype) + ridge * w)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
