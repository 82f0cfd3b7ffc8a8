"""Linear support vector machines by dual coordinate descent, and the sigmoid that turns margins into probabilities.

These fit on bounded samples only (see the callers' documented bounds); everything that follows the corpus runs on Spark.
"""

from __future__ import annotations

import numpy as np


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, c: float = 1.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) of an L2-regularised L1-hinge-loss machine.

    rows: (indices, values) of each example; y: -1 or 1. Coordinates are visited in a fixed random order, and
    examples that stay at a bound are passed over (Hsieh and others, 2008).
    """
    w = np.zeros(dims + 1)
    alpha = np.zeros(len(rows))
    diag = np.array([v @ v + 1.0 for _, v in rows]) if rows else np.zeros(0)
    rng = np.random.default_rng(seed)
    active = np.arange(len(rows))
    for _ in range(epochs):
        rng.shuffle(active)
        moved, keep = 0.0, np.ones(len(active), dtype=bool)
        for n, i in enumerate(active):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + w[dims]) - 1.0
            if (alpha[i] == 0 and g > 1.0) or (alpha[i] == c and g < -1.0):
                keep[n] = False
                continue
            new = min(max(alpha[i] - g / diag[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[at] += step * v
                w[dims] += step
                moved = max(moved, abs(step))
        active = active[keep] if keep.any() else active
        if moved < 1e-3 * c:
            if len(active) == len(rows):
                break
            active = np.arange(len(rows))
    return w


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))), fitted by Newton steps on smoothed targets (Platt scaling)."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        d, s = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gb = d @ margin + 1e-3 * (a - 1), d.sum()
        haa, hab, hbb = s @ (margin * margin) + 1e-3, s @ margin, s.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 5.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - scale * da, b - scale * db
        if max(abs(da), abs(db)) < 1e-7:
            break
    return float(max(a, 1e-6)), float(b)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))
