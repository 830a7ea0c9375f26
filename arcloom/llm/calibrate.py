"""Turning raw classifier outputs into probabilities whose decision threshold is a given number."""

from __future__ import annotations

import numpy as np


def logit(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def sigmoid(z: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic regression of ``y`` on ``z``, by damped Newton steps with a small ridge."""
    x = np.stack([z, np.ones_like(z)], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ at)
        slope = x.T @ (weight * (p - y)) + 1e-2 * (at - [1, 0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at = at - step * min(1.0, 2.0 / (1e-9 + np.abs(step).max()))
    return max(1e-3, float(at[0])), float(at[1])


def threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut on ``z`` of highest weighted F1 for label 1, in the middle of the gap where it lies."""
    order = np.argsort(-z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    hit, picked = np.cumsum(weight * y), np.cumsum(weight)
    f1 = 2 * hit / (picked + (weight * y).sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)
