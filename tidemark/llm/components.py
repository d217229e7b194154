"""Connected components, and the spanning forest of a block product."""

from __future__ import annotations

import numpy as np

from ..operators.components import components, with_value

__all__ = ["components", "forest", "with_value"]


def forest(linked: np.ndarray) -> np.ndarray:
    """For a block product's boolean links, the smallest linked label of each row and column node.

    Nodes are numbered rows first, then columns; labels go to and fro until they rest.
    """
    m, n = linked.shape
    rows, cols = np.arange(m), np.arange(m, m + n)
    big = m + n
    for _ in range(m + n):
        new_cols = np.minimum(cols, np.where(linked, rows[:, None], big).min(axis=0, initial=big))
        new_rows = np.minimum(rows, np.where(linked, new_cols[None, :], big).min(axis=1, initial=big))
        if (new_rows == rows).all() and (new_cols == cols).all():
            break
        rows, cols = new_rows, new_cols
    return np.concatenate([rows, cols])
