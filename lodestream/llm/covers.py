"""Difference covers: sets of residues in which every distance occurs, so any two positions reach sampled ones by one common shift."""

from __future__ import annotations

import functools

import numpy as np

#: Perfect difference sets by period. Each non-zero distance modulo the period occurs once.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}


@functools.cache
def sampled(period: int) -> np.ndarray:
    """Whether each residue is in the cover."""
    out = np.zeros(period, bool)
    out[list(COVERS[period])] = True
    return out


@functools.cache
def shifts(period: int) -> np.ndarray:
    """The least shift that takes two residues into the cover, by both."""
    inside = sampled(period)
    out = np.full((period, period), period, np.int64)
    for t in reversed(range(period)):
        there = np.roll(inside, -t)  # residues that t takes into the cover
        out[np.ix_(there, there)] = t
    return out
