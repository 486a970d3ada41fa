"""A small logistic regression for the driver: dense numpy, full-batch Adam, fixed order, so it repeats exactly."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def adam(gradient, size: int, steps: int = 300, rate: float = 0.1) -> np.ndarray:
    """Minimise by Adam from zero; gradient(w) gives the gradient."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of x's columns and, last, the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    s = np.ones(len(y)) if weight is None else weight
    s = s / s.sum()
    keep = np.r_[np.ones(x.shape[1] - 1), 0.0]
    # the vectors take the matrix's type, or every product would copy the matrix to theirs
    return adam(lambda w: x.T @ (s * (sigmoid(x @ w.astype(x.dtype)) - y)).astype(x.dtype) + l2 * keep * w, x.shape[1])
