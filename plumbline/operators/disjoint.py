"""Disjoint sets over Arrow lists: which graphs of a batch are connected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's set, after joining a[i] with b[i].

    Each round hooks the larger root of an edge under the smaller and halves the paths until
    every node points at a root; edges inside a set are left out.  At least half of the roots that
    have an edge are hooked in a round.
    """
    up = np.arange(n)
    while len(a):
        x, y = up[a], up[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low < high
        a, b = a[open_], b[open_]
        np.minimum.at(up, high[open_], low[open_])
        while True:
            next_ = up[up]
            if np.array_equal(next_, up):
                break
            up = next_
    return up


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each value), rows that are null without any; null values are -1."""
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    return pc.fill_null(pc.list_flatten(lists), -1).to_numpy(zero_copy_only=False), row


def connected(n: pa.Array, u: pa.Array, v: pa.Array) -> pa.Array:
    """All rows at once, as one graph whose parts are the rows."""
    sizes = np.maximum(pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
    first = np.concatenate(([0], np.cumsum(sizes)))
    (a, row), (b, _) = _flat(u), _flat(v)
    inside = (a >= 0) & (b >= 0) & (a < sizes[row]) & (b < sizes[row])
    a, b, row = a[inside], b[inside], row[inside]
    up = roots(int(first[-1]), a + first[row], b + first[row])
    sets = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[up == np.arange(len(up))], minlength=len(sizes))
    known = pc.and_(pc.is_valid(n), pc.and_(pc.is_valid(u), pc.is_valid(v)))
    return pc.if_else(known, pa.array(sets == 1), pa.scalar(None, pa.bool_()))
