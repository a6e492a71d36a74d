"""Gradient-boosted trees of depth three for a logistic loss, on binned features."""

from __future__ import annotations

import numpy as np

TREES, DEPTH, BINS, RATE = 60, 3, 24, 0.3


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """(feature, threshold, value) arrays of complete trees, and the base score."""
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    base = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    score = np.full(n, base)
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    feature, threshold, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width = 1 << level
            key = ((node[:, None] * f + np.arange(f)) * BINS + binned).ravel()
            sums = [np.bincount(key, np.repeat(s, f), minlength=width * f * BINS).reshape(width, f, BINS).cumsum(2) for s in (g, h)]
            whole = [s[:, :1, -1:] for s in sums]
            left, right = sums, [w - s for w, s in zip(whole, sums)]
            gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - whole[0] ** 2 / (whole[1] + 1)
            gain[(left[1] < 1) | (right[1] < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                at = width - 1 + k
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, at], threshold[t, at] = j, cuts[j][b]
            at = width - 1 + node
            node = 2 * node + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        gs, hs = np.bincount(node, g, minlength=leaves), np.bincount(node, h, minlength=leaves)
        value[t] = -RATE * gs / (hs + 1)
        score += value[t, node]
    return feature, threshold, value, base


def predict(model, x: np.ndarray) -> np.ndarray:
    """Log-odds."""
    feature, threshold, value, base = model
    at = np.arange(len(x))
    out = np.full(len(x), base)
    for f, t, v in zip(feature, threshold, value):
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            i = (1 << level) - 1 + node
            node = 2 * node + (x[at, f[i]] > t[i])
        out += v[node]
    return out
