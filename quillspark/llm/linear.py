"""Small linear models on the driver, fitted on a bounded sample; scoring is a table lookup in Arrow batches."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights (d, k) and intercepts (k) for targets y (n, k) in 0/1, classes weighted evenly; accelerated full-batch descent."""
    y = y.reshape(len(y), -1).astype(np.float32)
    share = np.clip(y.mean(0), 1e-6, 1 - 1e-6)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / len(y)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    rate = 4 / (float((x * x).sum(1).max() + 1) * float(weight.max()) * len(y))
    ahead_w, ahead_b = w, b
    for t in range(steps):
        gap = (sigmoid(x @ ahead_w + ahead_b) - y) * weight
        new_w, new_b = ahead_w - rate * (x.T @ gap + ridge * ahead_w), ahead_b - rate * gap.sum(0)
        momentum = t / (t + 3)
        ahead_w, ahead_b, w, b = new_w + momentum * (new_w - w), new_b + momentum * (new_b - b), new_w, new_b
    return w, b


def fit_platt(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """p = sigmoid(a * margin + b), by Newton steps on smoothed targets (Platt's rule); a stays positive."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        g, v = p - target, p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(g * margin).sum(), g.sum()])
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)
