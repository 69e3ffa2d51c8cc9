"""Gradient-boosted trees on a bounded training table, applied to numpy arrays inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete binary trees of one depth: split features and thresholds by heap place, leaf values."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(x) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner] if len(x) else 0.0
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.35, ridge: float = 1.0) -> Trees:
    """Logistic loss, Newton leaves, histograms of ``BINS`` quantile bins."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(d)]
    code = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(d)], axis=1)
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner = (1 << depth) - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            best = np.full(nodes, 1e-6)
            for f in range(d):
                key = (at - first) * BINS + code[:, f]
                gs = np.bincount(key, g, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                hs = np.bincount(key, h, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                left, right = gs[:, :-1], gs[:, -1:] - gs[:, :-1]
                gain = left**2 / (hs[:, :-1] + ridge) + right**2 / (hs[:, -1:] - hs[:, :-1] + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                gain = gain[:, : len(edges[f])]
                if not gain.shape[1]:
                    continue
                cut = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(nodes), cut] > best):
                    best[k], feature[first + k], threshold[first + k] = gain[k, cut[k]], f, edges[f][cut[k]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        place = at - inner
        leaf = rate * np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + ridge)
        score += leaf[place]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))
