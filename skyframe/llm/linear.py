"""Logistic regression for small dense problems, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int, balance: bool = False, used: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept by Nesterov's accelerated gradient; the intercept is not penalised.

    `used` marks the rows to fit; the others weigh nothing, so that x, which can be large, isn't copied.
    """
    d = x.shape[1]
    weight = np.ones(len(y), np.float32) if used is None else used.astype(np.float32)
    n = float(weight.sum())
    if balance:
        share = float((weight * y).sum()) / n
        weight = weight * np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    bound = 0.25 * weight.max() * (float(np.einsum("ij,ij->i", x, x).max()) + 1) + penalty
    w, b = np.zeros(d, np.float32), 0.0
    w_at, b_at, t = w, b, 1.0
    for _ in range(steps):
        g = (weight * (sigmoid(x @ w_at + b_at) - y) / n).astype(np.float32)
        w_next = w_at - (x.T @ g + penalty * w_at) / np.float32(bound)
        b_next = b_at - float(g.sum()) / bound
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w_at = w_next + np.float32((t - 1) / t_next) * (w_next - w)
        b_at = b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return w, b


def fit_platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of Platt's calibration, with his smoothed targets, by Newton's method."""
    up, down = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a = np.array([1.0, 0.0])
    f = np.stack([z.astype(float), np.ones(len(z))], 1)
    for _ in range(50):
        p = sigmoid(f @ a)
        grad = f.T @ (p - target) + 1e-6 * a
        hess = (f * (p * (1 - p))[:, None]).T @ f + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a = a - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0]), float(a[1])
