"""Gradient-boosted trees in numpy: softmax loss, second-order leaf values, features in quantile bins."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BINS = 32


class Trees(NamedTuple):
    edges: np.ndarray  # (features, BINS - 1) upper ends of the bins
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes): bins above go right
    value: np.ndarray  # (trees, leaves)
    classes: int  # tree t is of class t % classes
    base: np.ndarray  # (classes) scores before the first tree


def bins(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def _leaves(feature: np.ndarray, cut: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leaf number of each row in one tree of full depth."""
    at, rows, inner = np.zeros(len(b), dtype=np.int64), np.arange(len(b)), len(feature)
    while inner:
        at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        inner //= 2
    return at - len(feature)


def _tree(b: np.ndarray, grad: np.ndarray, hess: np.ndarray, features: np.ndarray, depth: int, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best splits level by level, by the gain of the second-order loss; a node without a gain sends all rows left."""
    feature, cut = np.zeros((1 << depth) - 1, dtype=np.int64), np.full((1 << depth) - 1, BINS, dtype=np.int64)
    node = np.zeros(len(b), dtype=np.int64)
    for level in range(depth):
        n = 1 << level
        best = np.full(n, 1e-6)
        for f in features:
            cell = node * BINS + b[:, f]
            g = np.bincount(cell, grad, n * BINS).reshape(n, BINS).cumsum(axis=1)
            h = np.bincount(cell, hess, n * BINS).reshape(n, BINS).cumsum(axis=1)
            all_g, all_h = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < 1) | (all_h - h < 1)] = 0
            spot = gain.argmax(axis=1)
            top = gain[np.arange(n), spot]
            better = top > best
            best[better] = top[better]
            feature[n - 1 : 2 * n - 1][better] = f
            cut[n - 1 : 2 * n - 1][better] = spot[better]
        here = n - 1 + node
        node = 2 * node + (b[np.arange(len(b)), feature[here]] > cut[here])
    g, h = np.bincount(node, grad, 1 << depth), np.bincount(node, hess, 1 << depth)
    return feature, cut, -g / (h + ridge)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 30, depth: int = 4, rate: float = 0.3, ridge: float = 2.0, part: float = 0.5, seed: int = 1) -> Trees:
    """Trees for labels 0 .. classes - 1, each from a ``part`` of rows and features; the same input gives the same trees."""
    rng = np.random.default_rng(seed)
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    b = bins(edges, x)
    base = np.log((np.bincount(y, minlength=classes) + 1.0) / (len(y) + classes))
    score = np.tile(base, (len(x), 1))
    parts = []
    for _ in range(rounds):
        p = softmax(score)
        for c in range(classes):
            rows = rng.choice(len(y), max(1, int(part * len(y))), replace=False)
            features = np.sort(rng.choice(b.shape[1], max(1, int(part * b.shape[1])), replace=False))
            own = p[rows, c]
            feature, cut, value = _tree(b[rows], own - (y[rows] == c), own * (1 - own) + 1e-6, features, depth, ridge)
            parts.append((feature, cut, rate * value))
            score[:, c] += rate * value[_leaves(feature, cut, b)]
    return Trees(edges, *(np.array(v) for v in zip(*parts, strict=True)), classes, base)


def log_probabilities(trees: Trees, x: np.ndarray) -> np.ndarray:
    """(rows, classes)"""
    b = bins(trees.edges, x)
    score = np.tile(trees.base, (len(x), 1))
    for t, (feature, cut, value) in enumerate(zip(trees.feature, trees.cut, trees.value, strict=True)):
        score[:, t % trees.classes] += value[_leaves(feature, cut, b)]
    return np.log(np.maximum(softmax(score), 1e-9))
