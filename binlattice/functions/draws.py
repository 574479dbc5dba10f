"""Exact draws without replacement from counts of any size."""

from __future__ import annotations

import numpy as np

FEW = 256


def split(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """How many of so many draws without replacement fall on each of the counts: a multivariate hypergeometric sample.

    Every item is kept with the same chance, and the few that are then too many or
    missing are drawn, by the same rule, from those kept or left: given its
    total, a thinned sample is uniform, so the result is exact. Each round has about
    the square root of the draws before, whatever the counts, and work is by number
    of counts and not by their size.
    """
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not 0 <= draws <= total:
        raise ValueError(f"{draws} draws from {total}")
    if draws > total - draws:
        return counts - split(rng, counts, total - draws)
    if draws <= FEW:
        return picked(rng, counts, draws)
    kept = rng.binomial(counts, draws / total)
    over = int(kept.sum()) - draws
    if over >= 0:
        return kept - split(rng, kept, over)
    return kept + split(rng, counts - kept, -over)


def picked(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """The same for few draws: distinct numbers of items, looked up in the running totals."""
    upto = np.cumsum(counts)
    chosen: set[int] = set()
    while len(chosen) < draws:
        chosen.add(int(rng.integers(upto[-1])))
    return np.bincount(np.searchsorted(upto, np.array(sorted(chosen), dtype=np.int64), side="right"), minlength=len(counts)).astype(np.int64)
