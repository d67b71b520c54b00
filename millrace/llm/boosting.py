"""Gradient-boosted trees for small tabular problems, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Logistic boosting of depth-limited trees with histogram splits.

    A tree is kept as a complete binary tree in arrays, so scoring a batch is
    ``depth`` rounds of indexing for each tree.
    """

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    l2: float = 1.0
    prior: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    platt: tuple[float, float] = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], 1)
        mean = y.mean()
        self.prior = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            feat, cut, leaf = np.zeros(size, np.int32), np.full(size, np.inf), np.zeros(size)
            at = np.zeros(n, np.int64)
            for node in range(size):
                own = at == node
                gs, hs = g[own].sum(), h[own].sum()
                leaf[node] = self.rate * gs / (hs + self.l2)
                if node >= size // 2 or own.sum() < 8:
                    continue
                best, whole = 1e-9, gs * gs / (hs + self.l2)
                for j in range(m):
                    if not len(cuts[j]):
                        continue
                    k = len(cuts[j]) + 1
                    cg = np.cumsum(np.bincount(binned[own, j], g[own], k))[:-1]
                    ch = np.cumsum(np.bincount(binned[own, j], h[own], k))[:-1]
                    gain = cg**2 / (ch + self.l2) + (gs - cg) ** 2 / (hs - ch + self.l2) - whole
                    b = int(gain.argmax())
                    if gain[b] > best:
                        best, feat[node], cut[node] = gain[b], j, cuts[j][b]
                if np.isfinite(cut[node]):
                    at[own] = 2 * node + 1 + (x[own, feat[node]] > cut[node])
                # rows of a node that isn't split stay there and take its value
            self.trees.append((feat, cut, leaf))
            score += leaf[at]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feat, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                go = np.isfinite(cut[at])
                at = np.where(go, 2 * at + 1 + (x[rows, feat[at]] > cut[at]), at)
            out += leaf[at]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt scaling on rows not used in fit()."""
        s, (a, b) = self.raw(x), (1.0, 0.0)
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(400):
            p = 1 / (1 + np.exp(-(a * s + b)))
            d = p - t
            a, b = a - 0.05 * (d * s).mean() * 4, b - 0.05 * d.mean() * 4
        self.platt = (float(a), float(b))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-(a * self.raw(x) + b)))
