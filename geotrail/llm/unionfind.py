"""Vectorised union-find over small integer nodes (inside one task)."""

from __future__ import annotations

import numpy as np


def roots(parent: np.ndarray) -> np.ndarray:
    """Pointer-jump until every node points at its root (in place)."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent[:] = up


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a[i] and b[i]; a set's root is its smallest node.

    ``parent`` must be flat (each node points at its root) and stays so."""
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        roots(parent)
