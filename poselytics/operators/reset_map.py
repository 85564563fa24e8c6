"""Threshold accumulators: ``acc += step; if acc >= limit: acc = 0``.

Inactivity timers and data-anchored windows are all of this form. A
:func:`reset_map` describes a run of steps as a function of the entry value, so
chunks of one session can be processed independently and chained afterwards.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# pieces kept per chunk (24 bytes each); beyond them the chunk is replayed with its
# real entry value. A chunk needs as many as it has steps within twice the limit.
MAX_PIECES = 1 << 14


class ResetMap(NamedTuple):
    """Piecewise result: entry values that first reset at the same step share an exit."""

    sums: np.ndarray  # running sum that must be reached, ascending
    exits: np.ndarray
    counts: np.ndarray
    total: int
    peak: int | None  # None: no steps at all
    fresh: tuple[int, int]  # exit and resets when restarted at the first step

    def exit(self, acc: int, limit: int) -> tuple[int, int] | None:
        """``(value, resets)`` after all steps, or None if the map is too coarse to tell."""
        need = limit - acc
        if self.peak is None or need > self.peak:
            return acc + self.total, 0
        piece = int(np.searchsorted(self.sums, need, side="left"))
        if piece < len(self.sums):
            return int(self.exits[piece]), int(self.counts[piece])
        return None


_EMPTY = np.empty(0, dtype=np.int64)


def reset_map(steps: np.ndarray, limit: int) -> ResetMap:
    n = len(steps)
    if n == 0:
        return ResetMap(_EMPTY, _EMPTY, _EMPTY, 0, None, (0, 0))
    sums = np.cumsum(steps, dtype=np.int64)
    highs = np.maximum.accumulate(sums)
    total, peak = int(sums[-1]), int(highs[-1])
    exits = [0] * n
    counts = [0] * n
    if limit <= 0 or int((highs - sums).max()) >= limit:
        # not monotone enough to search: describe nothing, only "restart" is walked
        acc = resets = 0
        for step in steps[1:].tolist():
            acc += step
            if acc >= limit:
                acc, resets = 0, resets + 1
        return ResetMap(_EMPTY, _EMPTY, _EMPTY, total, np.iinfo(np.int64).max, (acc, resets))
    # first step at which an accumulator restarted after step j resets again
    following = np.searchsorted(highs, sums + limit, side="left").tolist()
    ends = (total - sums).tolist()
    for j in range(n - 1, -1, -1):
        k = following[j]
        if k < n:
            exits[j], counts[j] = exits[k], counts[k] + 1
        else:
            exits[j] = ends[j]
    records = [0, *(np.flatnonzero(sums[1:] > highs[:-1]) + 1).tolist()]
    pieces: list[tuple[int, int, int]] = []
    for j in records:
        piece = (int(sums[j]), exits[j], counts[j] + 1)
        if pieces and pieces[-1][1:] == piece[1:]:
            pieces[-1] = piece
        elif len(pieces) == MAX_PIECES:
            break
        else:
            pieces.append(piece)
        # entry values are never far below zero, so larger sums are never asked for
        if piece[0] >= 2 * limit:
            break
    columns = np.array(pieces, dtype=np.int64).T
    return ResetMap(*columns, total, peak, (exits[0], counts[0]))
