"""Word shingles of a text as sorted 64-bit numbers."""

from __future__ import annotations

import numpy as np

from .anchors import Text, mixed

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_inside = np.ones(256, bool)
_inside[[9, 10, 11, 12, 13, 32]] = False
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def word_numbers(data: np.ndarray) -> np.ndarray:
    """One number per word; A-Z count as a-z."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _inside[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return Text(_lower[data]).hashes(edges[::2], edges[1::2])


def shingles(text: bytes, size: int) -> np.ndarray:
    """Distinct runs of `size` words; a text with fewer words is one run; without words there is none."""
    with np.errstate(over="ignore"):
        words = word_numbers(np.frombuffer(text, np.uint8))
        if not len(words):
            return words
        run = min(size, len(words))
        total = np.full(len(words) - run + 1, np.uint64(run))
        for i in range(run):
            total = mixed(total * _FACTOR + words[i:len(words) - run + 1 + i])
        return np.unique(total)
