"""Grams of a text that every text which contains it has too: the least hash of each window (minimisers)."""

from __future__ import annotations

import numpy as np

#: Lengths in bytes from which a text is looked for by windows of that length, each with the bytes of a gram.
TIERS = {1: 1, 2: 2, 4: 4, 8: 6, 16: 10, 32: 12, 64: 16, 128: 16}
_STEPS = (np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def tier_of(size: int) -> int:
    """The largest tier that a text of so many bytes fills; 0 for an empty one."""
    return max((t for t in TIERS if t <= size), default=0)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def minimisers_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tier: int, doubled: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of the texts that stand one after another in ``data``: each one's distinct least gram hashes of all its windows of ``tier`` bytes.

    If one text contains another, it has all of the other's. Texts shorter than the tier have none. Grams are as long as the tier says, ``doubled``
    so many times: of a longer gram more of a text's bytes are within a least one, so that texts which differ share fewer of them, and there are more.
    """
    size = TIERS[tier]
    gram = size << doubled
    width = tier - gram + 1
    counts = np.maximum(ends - starts - tier + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(data) - size + 1
    least = np.zeros(n, np.uint64)
    wide = data.astype(np.uint64) + np.uint64(1)
    for j in range(size):
        least += wide[j : j + n] * _STEPS[j]
    least = _mixed(least)
    while size < gram:
        least = _mixed(least[:-size] * _STEPS[0] + least[size:] * _STEPS[1])
        size *= 2
    done = 1
    while done < width:  # the least of 2, 4, 8 ... grams, then of the rest
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    rows = np.repeat(np.arange(len(counts)), counts)
    found = least[np.arange(len(rows)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)]
    new = np.ones(len(rows), bool)  # neighbours mostly share their least gram
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    rows, found = rows[new], found[new]
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    return rows[new], found[new].view(np.int64)


def minimisers(data: np.ndarray, tier: int) -> np.ndarray:
    """The distinct least gram hashes of all windows of ``tier`` bytes of one text."""
    return minimisers_of(data, np.zeros(1, np.int64), np.array([len(data)]), tier)[1]
