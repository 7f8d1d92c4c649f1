"""Gradient-boosted trees on binned dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Depth-limited trees for the logistic loss; a tree is a full binary tree in arrays."""

    edges: list[np.ndarray]
    base: float
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Boosted:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        codes = np.column_stack([np.searchsorted(edges[j], x[:, j], side="right") for j in range(d)])
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        model = Boosted(edges, float(np.log(p / (1 - p))), depth)
        f = np.full(n, model.base)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            feature, cut, value = np.full(2**depth - 1, -1), np.zeros(2**depth - 1, dtype=int), np.zeros(2 ** (depth + 1) - 1)
            node = np.zeros(n, dtype=int)
            for k in range(2**depth - 1):
                own = np.flatnonzero(node == k)
                best = _split(codes[own], g[own], h[own], edges, l2, least) if len(own) > 1 else None
                if best is None:
                    continue
                feature[k], cut[k] = best
                node[own] = 2 * k + 1 + (codes[own, best[0]] > best[1])
            for k in range(2 ** (depth + 1) - 1):
                own = node == k
                if own.any():
                    value[k] = rate * g[own].sum() / (h[own].sum() + l2)
            f += value[node]
            model.trees.append((feature, cut, value))
        return model

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes = np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node, moving = np.zeros(len(x), dtype=int), np.ones(len(x), dtype=bool)
            for _ in range(self.depth):
                at = np.where(moving, np.minimum(node, len(feature) - 1), 0)
                moving &= feature[at] >= 0
                node = np.where(moving, 2 * node + 1 + (codes[rows, np.maximum(feature[at], 0)] > cut[at]), node)
            f += value[node]
        return f


def _split(codes: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], l2: float, least: float) -> tuple[int, int] | None:
    total_g, total_h = g.sum(), h.sum()
    best, found = 1e-6, None
    for j, e in enumerate(edges):
        if not len(e):
            continue
        left_g = np.cumsum(np.bincount(codes[:, j], g, len(e) + 1))[:-1]
        left_h = np.cumsum(np.bincount(codes[:, j], h, len(e) + 1))[:-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - total_g**2 / (total_h + l2)
        gain[(left_h < least * 0.05) | (right_h < least * 0.05)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = float(gain[k]), (j, k)
    return found


@dataclass
class Isotonic:
    """A non-decreasing step function with linear parts between, fitted by pooling violators."""

    at: np.ndarray
    value: np.ndarray

    @staticmethod
    def fit(margin: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []
        for m, v in zip(margin[order], y[order]):
            blocks.append([float(v), 1.0, float(m)])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                s, n, m2 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, (blocks[-1][2] * blocks[-1][1] + m2 * n) / (blocks[-1][1] + n)]
        return Isotonic(np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks]))

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value) if len(self.at) else 1 / (1 + np.exp(-margin))
