"""Union-find over numpy arrays, for the links that one task finds."""

import numpy as np


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (every entry a root) after the nodes ``a[i]`` and ``b[i]`` were united; roots are the smallest."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if len(a):
            low, high = np.minimum(a, b), np.maximum(a, b)
            parent = parent.copy()
            np.minimum.at(parent, high, low)
            parent = roots(parent)
    return parent
