"""The lattice E8: nearest points, shortest vectors, and hashes of cells made of several points.

Coordinates are whole numbers of units, ``HALF`` units to a half, so that every product and sum is
exact in doubles whatever the order of summation: equal vectors have equal cells in every task.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np

DIMS = 8
HALF = 1 << 15
_ONE = 2 * HALF


def _shortest() -> np.ndarray:
    """The 240 shortest vectors, in halves."""
    rows = []
    for i, j in combinations(range(DIMS), 2):
        for a, b in product((2, -2), repeat=2):
            row = [0] * DIMS
            row[i], row[j] = a, b
            rows.append(row)
    rows += [list(s) for s in product((1, -1), repeat=DIMS) if np.prod(s) > 0]
    return np.array(rows, np.int64)


SHORTEST = _shortest()


def _nearest_even(points: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of an even sum, in halves."""
    whole = np.floor((points + HALF) / _ONE)
    rest = points - whole * _ONE
    odd = np.flatnonzero(whole.sum(axis=1) % 2)
    worst = np.abs(rest[odd]).argmax(axis=1)
    whole[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return whole * 2


def nearest(points: np.ndarray) -> np.ndarray:
    """Per row of eight coordinates the nearest lattice point, in halves."""
    even = _nearest_even(points)
    shifted = _nearest_even(points - HALF) + 1
    far = ((points - even * HALF) ** 2).sum(axis=1) > ((points - shifted * HALF) ** 2).sum(axis=1)
    return np.where(far[:, None], shifted, even)


class Cells:
    """Random projections of ``dim`` dimensions to cells of ``tables`` tables.

    A cell is ``blocks`` lattice points, of eight projected dimensions each. ``width`` is the
    length, on the unit sphere, of one step of the lattice. A cell's key is a linear hash of its
    points, so that a neighbour's key is the cell's own plus a step; the lowest bits of a key are
    its table's number.
    """

    def __init__(self, dim: int, tables: int, blocks: int, width: float, seed: int = 8) -> None:
        random = np.random.default_rng([seed, dim])
        self.tables, self.blocks, self.dim = tables, blocks, dim
        # Rows of Gaussian numbers, made orthogonal as far as ``dim`` has room.
        wide = []
        for _ in range(tables):
            drawn = random.normal(size=(blocks * DIMS, dim))
            if blocks * DIMS <= dim:
                drawn = np.linalg.qr(drawn.T)[0].T
            else:
                drawn /= np.linalg.norm(drawn, axis=1)[:, None]
            wide.append(drawn)
        self.projection = np.rint(np.concatenate(wide).T * (1 << 16))
        self.unit = HALF * 2 / (width * (1 << 36))
        odd = random.integers(0, 1 << 62, blocks * DIMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._low = np.uint64((1 << max(1, (tables - 1).bit_length())) - 1)
        # Multiples of the table count's power of two leave the lowest bits to the table's number.
        self.factors = (odd * (self._low + np.uint64(1))).view(np.int64)
        steps = [SHORTEST @ self.factors[k * DIMS : (k + 1) * DIMS] for k in range(blocks)]
        self.steps = np.concatenate(steps)

    def keys(self, units: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Per unit vector and table the key of its own cell, and ``probes`` steps to the nearest others.

        A step is a place in ``steps``; ``own + steps[step]`` is the key of the cell it leads to.
        """
        rows = len(units)
        whole = np.rint(units * (1 << 20))
        points = np.rint(whole @ self.projection * self.unit).reshape(-1, DIMS)
        near = nearest(points)
        table = np.arange(self.tables, dtype=np.int64)
        halves = near.astype(np.int64).reshape(rows, self.tables, self.blocks * DIMS)
        own = halves @ self.factors + table
        # The more a step agrees with what the point has over its lattice point, the nearer it leads.
        gain = (points - near * HALF) @ SHORTEST.T.astype(np.float64)
        gain = gain.reshape(rows * self.tables, self.blocks * len(SHORTEST))
        order = np.argpartition(-gain, probes - 1, axis=1)[:, :probes] if probes else gain[:, :0]
        return own, order.reshape(rows, self.tables, probes).astype(np.int16)
