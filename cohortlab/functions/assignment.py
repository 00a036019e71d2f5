"""Optimal one-to-one assignment of a small weight table (numpy, on the driver)."""

from __future__ import annotations

import numpy as np


def best_assignment(weight: np.ndarray) -> list[int]:
    """Column of each row so that the summed weight is largest; rows <= columns.

    Shortest augmenting paths with potentials: rows * rows * columns steps.  A row enters
    with its reduced costs; the path to the nearest free column is flipped, and the
    potentials keep every reduced cost at 0 or more.
    """
    rows, columns = weight.shape
    cost = weight.max(initial=0.0) - weight
    of_row, of_column = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)
    for new in range(rows):
        slack, via = np.full(columns, np.inf), np.full(columns, -1)
        done = np.zeros(columns, bool)
        row, column, reached = new, -1, 0.0
        while row >= 0:
            through = reached + cost[row] - of_row[row] - of_column
            better = ~done & (through < slack)
            slack[better], via[better] = through[better], column
            column = int(np.argmin(np.where(done, np.inf, slack)))
            reached, done[column] = slack[column], True
            row = owner[column]
        settled = np.flatnonzero(done)
        of_row[new] += reached
        inner = settled[owner[settled] >= 0]
        of_row[owner[inner]] += reached - slack[inner]
        of_column[settled] -= reached - slack[settled]
        while column >= 0:
            before = via[column]
            owner[column] = owner[before] if before >= 0 else new
            column = before
    out = np.empty(rows, int)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out.tolist()
