"""A generalised additive model with pairwise terms: cyclic boosting of shallow trees over bins.

Every feature is cut into bins. Round by round, each feature in turn gets a small tree over its bins
that follows the current gradient; a tree only adds to the feature's table of one number per bin.
Then the pairs that explain most of what is left get tables of their own in the same way. A score
is the sum of one entry per table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32
PAIR_BINS = 8


@dataclass
class AdditiveModel:
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def margins(self, features: np.ndarray) -> np.ndarray:
        total = np.full(len(features), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], features[:, k], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            row = np.searchsorted(self.pair_edges[a], features[:, a], side="right")
            column = np.searchsorted(self.pair_edges[b], features[:, b], side="right")
            total += table[row, column]
        return total

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(features), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    cuts = np.quantile(values, np.arange(1, bins) / bins, method="higher")
    return np.unique(cuts[cuts > values.min()])


def _gain(gradient, weight, smooth: float):
    return gradient**2 / (weight + smooth)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """Per bin the value of its leaf: the bins are cut ``leaves - 1`` times where the gain is most."""
    cuts = [0, len(gradient)]
    g = np.concatenate([[0], np.cumsum(gradient)])
    w = np.concatenate([[0], np.cumsum(weight)])

    def best(low: int, high: int) -> tuple[float, int]:
        if high - low < 2:
            return 0.0, low
        at = np.arange(low + 1, high)
        gains = _gain(g[at] - g[low], w[at] - w[low], smooth)
        gains = gains + _gain(g[high] - g[at], w[high] - w[at], smooth)
        gains -= _gain(g[high] - g[low], w[high] - w[low], smooth)
        return float(gains.max()), int(at[gains.argmax()])

    for _ in range(leaves - 1):
        options = [best(low, high) for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
        gain, at = max(options)
        if gain <= 1e-9:
            break
        cuts = sorted({*cuts, at})
    values = np.zeros(len(gradient))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        values[low:high] = (g[high] - g[low]) / (w[high] - w[low] + smooth)
    return values


def _grid_tree(gradient: np.ndarray, weight: np.ndarray, smooth: float) -> np.ndarray:
    """Values of a tree of four leaves over a grid: one cut, then one cut of the other side each."""
    best, values = -np.inf, np.zeros_like(gradient)
    for turned in (False, True):
        g, w = (gradient.T, weight.T) if turned else (gradient, weight)
        for at in range(1, len(g)):
            out = np.empty_like(g)
            gain = 0.0
            for half in (slice(0, at), slice(at, len(g))):
                sums, weights = g[half].sum(axis=0), w[half].sum(axis=0)
                leaf = _tree(sums, weights, 2, smooth)
                out[half] = leaf
                gain += float((leaf * sums).sum())
            if gain > best:
                best, values = gain, out.T if turned else out
    return np.array(values)


def fit(
    features: np.ndarray,
    labels: np.ndarray,
    rounds: int = 120,
    pair_rounds: int = 40,
    pairs: int = 6,
    rate: float = 0.15,
    leaves: int = 3,
    smooth: float = 5.0,
) -> AdditiveModel:
    """Fit by logistic loss. Without rows of both classes the model is the smoothed share of label 1."""
    positive = float(labels.sum())
    share = (positive + 1) / (len(labels) + 2)
    model = AdditiveModel(intercept=float(np.log(share / (1 - share))))
    if positive in (0, len(labels)):
        return model
    count = features.shape[1]
    model.edges = [_edges(features[:, k], BINS) for k in range(count)]
    model.pair_edges = [_edges(features[:, k], PAIR_BINS) for k in range(count)]
    bins = [np.searchsorted(model.edges[k], features[:, k], side="right") for k in range(count)]
    coarse = [np.searchsorted(model.pair_edges[k], features[:, k], side="right") for k in range(count)]
    model.tables = [np.zeros(len(edges) + 1) for edges in model.edges]
    margin = np.full(len(labels), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        chance = 1 / (1 + np.exp(-margin))
        return labels - chance, chance * (1 - chance)

    for _ in range(rounds):
        for k in range(count):
            gradient, weight = slopes()
            size = len(model.tables[k])
            step = rate * _tree(
                np.bincount(bins[k], gradient, size), np.bincount(bins[k], weight, size), leaves, smooth
            )
            model.tables[k] += step
            margin += step[bins[k]]
    gradient, weight = slopes()
    strength = []
    for a in range(count):
        for b in range(a + 1, count):
            g, w = _grid(coarse, model, a, b, gradient, weight)
            strength.append((float((_grid_tree(g, w, smooth) * g).sum()), a, b))
    model.pairs = [(a, b) for _, a, b in sorted(strength, reverse=True)[:pairs]]
    model.pair_tables = [
        np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs
    ]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            gradient, weight = slopes()
            step = rate * _grid_tree(*_grid(coarse, model, a, b, gradient, weight), smooth)
            table += step
            margin += step[coarse[a], coarse[b]]
    return model


def _grid(coarse, model, a: int, b: int, gradient, weight) -> tuple[np.ndarray, np.ndarray]:
    shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
    cell = coarse[a] * shape[1] + coarse[b]
    size = shape[0] * shape[1]
    return (
        np.bincount(cell, gradient, size).reshape(shape),
        np.bincount(cell, weight, size).reshape(shape),
    )
