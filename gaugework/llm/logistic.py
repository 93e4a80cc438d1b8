"""Logistic regression and calibration for the small models trained on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(z, np.float64)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent; both classes weigh the same.  One class gives zero weights.

    Products are taken in the type of ``x``, so that single precision is not widened to a second, larger matrix each round."""
    n, d = x.shape
    share = y.mean() if n else 0.5
    if not 0 < share < 1:
        return np.zeros(d), 0.0
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / n
    step = 1.0 / (0.25 * float((weight * ((x * x).sum(1) + 1)).sum()) * 1.0 + penalty)
    w, b = np.zeros(d), 0.0
    ahead_w, ahead_b = w, b
    for i in range(rounds):
        error = weight * (sigmoid(x @ ahead_w.astype(x.dtype) + ahead_b) - y)
        new_w = ahead_w - step * (error.astype(x.dtype) @ x + penalty * ahead_w)
        new_b = ahead_b - step * error.sum()
        pull = i / (i + 3)
        ahead_w, ahead_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b = new_w, new_b
    return w, float(b)


def calibrate(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn scores into probabilities (Platt), with his smoothed targets; slope is never negative."""
    good = float(y.sum())
    bad = len(y) - good
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * scores + b)
        error, curve = p - target, np.maximum(p * (1 - p), 1e-6)
        slope = np.array([(error * scores).sum() + 1e-3 * (a - 1), error.sum()])
        bend = np.array([[(curve * scores * scores).sum() + 1e-3, (curve * scores).sum()], [(curve * scores).sum(), curve.sum()]])
        move = np.linalg.solve(bend + 1e-9 * np.eye(2), slope)
        move *= min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)
