"""Anchors: places of a text that any two equal stretches of it share.

A gram is GRAM bytes. Every string of LENGTH bytes holds LENGTH - GRAM + 1 grams; those with the smallest hash are its
anchors. Two equal strings have their anchors at the same places, whatever stands around them.
"""

from __future__ import annotations

import numpy as np

_value = np.random.default_rng(31).integers(1, 2**63, 256, dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers: dict[str, np.ndarray] = {}


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        size = max(1 << 16, 1 << int(n).bit_length())
        for name, base in (("up", _FACTOR), ("down", _INVERSE)):
            table = np.full(size + 1, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


class Text:
    """Hashes of any stretch of one text, from the running sums of a polynomial over 64-bit numbers."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        up, self.down = _up_to(self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_value[data] * up[:self.n], out=self.sums[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])

    def all_grams(self, gram: int) -> np.ndarray:
        return mixed((self.sums[gram:] - self.sums[:-gram]) * self.down[:self.n - gram + 1])


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every run of `width` values: from blocks, running forwards and backwards."""
    n = len(values)
    fill = np.iinfo(np.uint64).max if least else np.uint64(0)
    op = np.minimum if least else np.maximum
    blocks = -(-n // width)
    padded = np.full(blocks * width, fill, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    forward = op.accumulate(grid, axis=1).ravel()
    backward = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(backward[:n - width + 1], forward[width - 1:n])


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, gram hashes, context hashes) of the anchors of a text.

    The context of an anchor reaches from LENGTH - GRAM bytes before its gram to as many behind it, or to the ends of the text.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(data) < length:
        return none
    text = Text(data)
    grams = text.all_grams(gram)
    width = length - gram + 1
    least = _sliding(grams, width, True)
    # A gram is an anchor if it is as small as the smallest of some window that it lies in.
    edge = np.zeros(width - 1, np.uint64)
    reach = _sliding(np.concatenate([edge, least, edge]), width, False)
    place = np.flatnonzero(grams <= reach)
    low, high = np.maximum(place - (length - gram), 0), np.minimum(place + length, len(data))
    context = text.hashes(low, high) + (place - low).astype(np.uint64) * _FACTOR + (high - low).astype(np.uint64) * _MIX
    return place, grams[place], mixed(context)
