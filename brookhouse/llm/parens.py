"""Balanced parentheses of a tree, with a range min-max tree over blocks of excess."""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Parens:
    """A tree in depth-first order as bits, 1 where a node opens and 0 where it closes.

    The excess at a bit is the number of nodes open after it. A node closes at the first later bit whose excess is below
    its own, which the least excess of each block, and of each pair of blocks, pair of pairs and so on, finds in logarithmic time.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(bool)
        n = len(bits)
        self.excess = np.cumsum(np.where(self.bits, 1, -1))
        self.blocks = 1 << max(0, -(-n // BLOCK) - 1).bit_length()
        far = np.iinfo(np.int64).max
        self.padded = np.full(self.blocks * BLOCK, far, np.int64)
        self.padded[:n] = self.excess
        self.least = np.full(2 * self.blocks, far, np.int64)
        self.least[self.blocks:] = self.padded.reshape(self.blocks, BLOCK).min(1)
        half = self.blocks
        while half > 1:
            self.least[half // 2:half] = np.minimum(self.least[half:2 * half:2], self.least[half + 1:2 * half:2])
            half //= 2
        # Ranks: of nodes opened, and of leaves (a node that closes at once), before each bit and at the end.
        self.opened = np.concatenate([[0], np.cumsum(self.bits)])
        leaf = self.bits.copy()
        leaf[:-1] &= ~self.bits[1:]
        leaf[-1:] = False
        self.leaves = np.concatenate([[0], np.cumsum(leaf)])

    def opens(self) -> np.ndarray:
        """Where each node opens, in depth-first order."""
        return np.flatnonzero(self.bits)

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Where the nodes that open at the given bits close."""
        below = self.excess[opens] - 1
        found = np.full(len(opens), -1)
        # In the rest of the own block.
        todo = np.arange(len(opens))
        at = opens + 1
        while True:
            todo = todo[at[todo] % BLOCK != 0]
            if not len(todo):
                break
            hit = self.padded[at[todo]] <= below[todo]
            found[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
        # Up until a block to the right goes low enough, then down to the first such block.
        rest = np.flatnonzero(found < 0)
        node = opens[rest] // BLOCK + self.blocks
        climbing = np.ones(len(rest), bool)
        while climbing.any():
            left = climbing & (node % 2 == 0)
            low = np.zeros(len(rest), bool)
            low[left] = self.least[node[left] + 1] <= below[rest[left]]
            node[low] += 1
            climbing &= ~low
            node[climbing] //= 2
        while (node < self.blocks).any():
            inner = node < self.blocks
            node[inner] *= 2
            node[inner] += self.least[node[inner]] > below[rest[inner]]
        begin = (node - self.blocks) * BLOCK
        for step in range(BLOCK):
            open_still = found[rest] < 0
            hit = open_still & (self.padded[np.minimum(begin + step, len(self.padded) - 1)] <= below[rest])
            found[rest[hit]] = begin[hit] + step
        return found


def encode(parent: np.ndarray) -> tuple[Parens, np.ndarray]:
    """The parentheses of a forest given by the parent of each node (-1: none), and the nodes in depth-first order."""
    n = len(parent)
    by_parent = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[by_parent], np.arange(-1, n + 1)).tolist()
    children = by_parent.tolist()
    bits, order = [], []
    todo = children[first[0]:first[1]][::-1]
    while todo:
        node = todo.pop()
        if node < 0:
            bits.append(0)
            continue
        bits.append(1)
        order.append(node)
        todo.append(-1)
        todo += children[first[node + 1]:first[node + 2]][::-1]
    return Parens(np.array(bits, np.int8)), np.array(order, np.int64)
