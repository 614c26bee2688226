"""Suffix array by prefix doubling over groups (whole arrays at a time, no loop over symbols).

First the suffixes are sorted by as many symbols as one number holds.  Suffixes that agree so far form a
group, which knows the place of its first one.  In each round the groups of several are sorted by the
place of what follows the symbols compared so far, which doubles their number; a suffix that is alone
has its place for good.  The rounds end when all are alone, after the logarithm of the longest
repetition.
"""

from __future__ import annotations

import numpy as np


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of some ordered keys where its equals begin, and whether it has any."""
    other = np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])
    start = np.flatnonzero(other[:-1])
    return np.repeat(start, np.diff(np.append(start, len(ordered)))), ~(other[:-1] & other[1:])


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of the suffixes of an array of non-negative numbers in ascending order (an end comes before any symbol)."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    values, rank = np.unique(symbols, return_inverse=True)
    bits = len(values).bit_length()
    depth = 62 // bits
    # Number 0 stands behind the end.
    padded = np.concatenate([rank + 1, np.zeros(depth, np.int64)])
    keys = np.zeros(n, np.int64)
    for k in range(depth):
        keys = keys << bits | padded[k : k + n]
    order = np.argsort(keys)
    first, several = _groups(keys[order])
    place = np.full(n + 1, -1)
    place[order] = first
    tied = np.flatnonzero(several)
    while len(tied):
        # Suffixes that agree in so many symbols have them, so none is looked for behind the end.
        own = order[tied]
        keys = place[own] * (n + 1) + place[own + depth] + 1
        by = np.argsort(keys)
        own = order[tied] = own[by]
        first, several = _groups(keys[by])
        place[own] = tied[first]
        tied = tied[several]
        depth *= 2
    return order
