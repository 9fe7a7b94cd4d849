"""Small linear models trained with numpy: logistic regression, linear support vectors, calibration.

The weights are a few thousand numbers.  ``adam`` and ``newton`` ask for sums
over rows, which may lie in the cluster; the rest takes rows in memory.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash


def bucket(text: str, bits: int, seed: int = 0) -> int:
    """A feature's place in a table of 2**bits."""
    return xxhash.xxh32_intdigest(text, seed) & ((1 << bits) - 1)


class Dense:
    """A matrix of single precision, for rows with thousands of places."""

    def __init__(self, n: int, width: int):
        self.n, self.width = n, width
        self.x = np.zeros((n, width), np.float32)

    def put(self, row: int, cols: np.ndarray, vals: np.ndarray) -> None:
        np.add.at(self.x[row], cols, vals)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return (self.x @ w.astype(np.float32)).astype(np.float64)

    def back(self, g: np.ndarray) -> np.ndarray:
        return (g.astype(np.float32) @ self.x).astype(np.float64)


class Sparse:
    """Rows of (places, values) as one flat structure."""

    def __init__(self, rows: list[tuple[list[int], list[float]]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r[0]) for r in rows])
        self.col = np.array([c for r in rows for c in r[0]], dtype=np.int64)
        self.val = np.array([v for r in rows for v in r[1]], dtype=np.float64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.col], minlength=self.n)[: self.n]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=self.val * g[self.row], minlength=self.width)


def adam(gradient: Callable[[np.ndarray], np.ndarray], width: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Full-batch adaptive gradient descent with momentum (Adam), deterministic; ``gradient(w)`` is over all rows, wherever they are."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _descend(x, slope, l2: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    def gradient(w: np.ndarray) -> np.ndarray:
        s = slope(x.dot(w[:-1]) + w[-1])
        return np.append(x.back(s) / x.n + l2 * w[:-1], s.mean())

    w = adam(gradient, x.width + 1, steps, rate)
    return w[:-1], float(w[-1])


def logistic(x: Sparse, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-5, steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    c = np.ones(x.n) if weight is None else weight
    return _descend(x, lambda z: c * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y), l2, steps, rate)


def support_vectors(x: Sparse | Dense, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Linear support vector classifier, squared hinge loss; y in {0, 1}."""
    c = np.ones(x.n) if weight is None else weight
    t = 2 * y - 1
    return _descend(x, lambda z: -2 * c * t * np.maximum(0, 1 - t * z), l2, steps, rate)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities, fitted on held-out rows."""
    if len(z) == 0 or y.min() == y.max():
        return 1.0, 0.0
    scale = float(np.abs(z).mean()) or 1.0
    x = Sparse([([0], [v / scale]) for v in z], 1)
    w, b = logistic(x, (y * (y.sum() + 1) / (y.sum() + 2)) + (1 - y) / (len(y) - y.sum() + 2), l2=1e-3, steps=400)
    return max(float(w[0]), 0.05) / scale, b


def newton(total: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, steps: int = 30) -> np.ndarray:
    """Minimum of a convex loss of few places; ``total(w)`` is its gradient and second derivatives over all rows, wherever they are."""
    w = np.zeros(width)
    for _ in range(steps):
        g, h = total(w)
        step = np.linalg.solve(h + 1e-9 * np.trace(h) * np.eye(width), g)
        w = w - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights that give both classes the same say."""
    p = max(1.0, y.sum())
    q = max(1.0, len(y) - y.sum())
    return np.where(y > 0, len(y) / (2 * p), len(y) / (2 * q))
