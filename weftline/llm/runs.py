"""Rows of equal keys in Arrow batches of a sorted partition."""

from __future__ import annotations

import numpy as np


def cuts(keys: list[np.ndarray]) -> np.ndarray:
    """Bounds of the runs of rows that agree in all keys: 0, the start of each further run, the number of rows."""
    n = len(keys[0])
    new = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]]) if n else np.zeros(1, np.int64)


def whole_runs(batches, keys: int):
    """Columns (as arrays) of one or more whole runs at a time; batches are sorted by their first ``keys`` columns.

    A run may go over many batches; only its own rows are held until it ends.
    """
    held: list[list[np.ndarray]] = []

    def together():
        return [np.concatenate(c) for c in zip(*held, strict=True)] if len(held) > 1 else held[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        last = int(cuts(cols[:keys])[-2])
        goes_on = bool(held) and all(held[-1][k][-1] == cols[k][0] for k in range(keys))
        if held and not goes_on:
            yield together()
            held = []
        if last:
            held.append([c[:last] for c in cols])
            yield together()
            held = []
        held.append([c[last:].copy() for c in cols])
    if held:
        yield together()
