"""Balanced parentheses of a tree in preorder, with a range min-max tree over blocks of excess.

All questions are asked for arrays of positions at once. The excess at a position is the number of
open less closed parentheses up to it. A block keeps its least excess, and each level above keeps
the least of two below, so the first place after a position where the excess falls below a value is
found by a scan of at most two blocks and a climb up and down the levels.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Parentheses:
    def __init__(self, open: np.ndarray):
        """``open`` is a boolean per parenthesis, true for an opening one."""
        self.open = open
        self.excess = np.cumsum(np.where(open, 1, -1), dtype=np.int32)
        padded = np.full(max(1, -(-len(open) // BLOCK)) * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(open)] = self.excess
        self.minima = [padded.reshape(-1, BLOCK).min(axis=1)]
        while len(self.minima[-1]) > 1:
            below = self.minima[-1]
            if len(below) % 2:
                below = np.append(below, np.iinfo(np.int32).max)
                self.minima[-1] = below
            self.minima.append(below.reshape(-1, 2).min(axis=1))
        self._padded = padded
        self.opened = np.cumsum(open)  # rank of opening parentheses

    def _scan(self, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First position of the block from ``start`` on with excess at most ``target``, or -1."""
        found = np.full(len(start), -1, np.int64)
        todo, at = np.arange(len(start)), start.copy()
        ends = (start // BLOCK + 1) * BLOCK
        while len(todo):
            inside = at[todo] < ends[todo]
            todo = todo[inside]
            hit = self._padded[at[todo]] <= target[todo]
            found[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
        return found

    def fall(self, positions: np.ndarray, drop: int) -> np.ndarray:
        """First position after each where the excess is ``drop`` less; it has to exist."""
        target = self.excess[positions] - drop
        found = np.full(len(positions), -1, np.int64)
        inner = (positions + 1) % BLOCK != 0
        found[inner] = self._scan(positions[inner] + 1, target[inner])
        todo = np.flatnonzero(found < 0)
        node, level_of = positions[todo] // BLOCK, np.full(len(todo), -1)
        goal = target[todo]
        for level, least in enumerate(self.minima):
            climb = np.flatnonzero(level_of < 0)
            left = climb[(node[climb] % 2 == 0) & (node[climb] + 1 < len(least))]
            hit = left[least[node[left] + 1] <= goal[left]]
            level_of[hit] = level
            node[hit] += 1
            node[np.flatnonzero(level_of < 0)] //= 2
        for level in range(len(self.minima) - 1, 0, -1):
            down = np.flatnonzero(level_of == level)
            first = node[down] * 2
            node[down] = np.where(self.minima[level - 1][first] <= goal[down], first, first + 1)
            level_of[down] = level - 1
        found[todo] = self._scan(node * BLOCK, goal)
        return found

    def close(self, positions: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        return self.fall(positions, 1)

    def outer_close(self, positions: np.ndarray) -> np.ndarray:
        """The closing parenthesis of the pair around each opening one; not for the root."""
        return self.fall(positions, 2)

    def leaf(self) -> np.ndarray:
        """For each opening parenthesis in order, whether it is closed at once."""
        at = np.flatnonzero(self.open)
        return ~self.open[at + 1]
