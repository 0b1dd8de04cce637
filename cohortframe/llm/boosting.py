"""Gradient-boosted trees on small integer features, with calibrated probabilities."""

from __future__ import annotations

import numpy as np


class Trees:
    """Additive regression trees of fixed depth for the logistic loss.

    A tree is complete: node ``n`` has the children ``2n + 1`` and ``2n + 2``; a node that does not split sends all rows
    left.  ``probability`` is calibrated by a logistic fit of the margin on rows kept out of the boosting.
    """

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []
        self.scale, self.shift = 1.0, 0.0

    def _leaf_of(self, x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        return node - (2 ** self.depth - 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            out += leaf[self._leaf_of(x, feature, cut)]
        return out

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        inner = 2 ** self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins)
        node = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            for n in range(2 ** level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == n)
                best = 1e-6
                total_g, total_h = g[rows].sum(), h[rows].sum()
                whole = total_g ** 2 / (total_h + self.ridge)
                for f in range(x.shape[1]):
                    lg = np.cumsum(np.bincount(x[rows, f], g[rows], self.bins))[:-1]
                    lh = np.cumsum(np.bincount(x[rows, f], h[rows], self.bins))[:-1]
                    gain = lg ** 2 / (lh + self.ridge) + (total_g - lg) ** 2 / (total_h - lh + self.ridge) - whole
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[n], cut[n] = gain[k], f, k
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        node -= inner
        g_leaf, h_leaf = (np.bincount(node, v, 2 ** self.depth) for v in (g, h))
        self.feature.append(feature)
        self.cut.append(cut)
        self.leaf.append(-self.rate * g_leaf / (h_leaf + self.ridge))

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Trees:
        """Boost on the rows not ``held``, calibrate on those held."""
        share = np.clip(y[~held].mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        xs, ys = x[~held], y[~held]
        f = np.full(len(xs), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            self._grow(xs, p - ys, p * (1 - p))
            f += self.leaf[-1][self._leaf_of(xs, self.feature[-1], self.cut[-1])]
        z, t = self.margin(x[held]), y[held]
        for _ in range(50):                        # Newton's method, two parameters, a weak pull to the margin as it is
            p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))
            d = np.array([((p - t) * z).sum() + (self.scale - 1), (p - t).sum() + self.shift])
            w = p * (1 - p)
            hess = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]])
            move = np.linalg.solve(hess, d)
            self.scale, self.shift = self.scale - move[0], self.shift - move[1]
            if abs(move).max() < 1e-6:
                break
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -30, 30)))


def precise_threshold(probability: np.ndarray, label: np.ndarray, precision: float, least: float = 0.5) -> float:
    """Above 1 if no threshold of at least ``least`` reaches ``precision``; else half way between the last probability
    that may be accepted and the next lower one."""
    order = np.argsort(-probability, kind="stable")
    p, good = probability[order], np.cumsum(label[order])
    last = np.append(p[1:] != p[:-1], True)                 # ties are accepted together
    fits = np.flatnonzero(last & (p >= least) & (good >= precision * np.arange(1, len(p) + 1)))
    if not len(fits):
        return 1.1
    below = p[fits[-1] + 1] if fits[-1] + 1 < len(p) else 0.0
    return max(least, float(p[fits[-1]] + below) / 2)
