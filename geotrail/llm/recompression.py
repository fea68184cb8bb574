"""A run-length grammar of a sequence by recompression, and common extensions by it.

Block compression replaces each maximal run of one symbol by a symbol for it and its length; pair
compression splits the symbols into left and right ones and replaces each left symbol with the
right one after it. Both alternate until one symbol is left. Equal stretches are replaced alike
but at their ends, so a longest common extension climbs while both sides stand at the edge of a
symbol, at most one step on each level, and from the first difference goes down again, at most
one step on each level. All queries take their steps together, in numpy.

Symbols are numbers given to equal blocks and equal pairs by sorting, so equal symbols stand for
equal stretches without any chance of error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from geotrail.llm.words import mixed

SPLITS = 3  # ways to split the symbols that are tried on each level


@dataclass
class Level:
    """``symbols``; whether the next level has ``blocks`` or pairs; the ``parent`` of each
    symbol there and the ``first`` symbol of each parent, with an end."""

    symbols: np.ndarray
    blocks: bool
    parent: np.ndarray
    first: np.ndarray


def _named(keys: np.ndarray, names: int) -> tuple[np.ndarray, int]:
    """New symbols for equal keys, from ``names`` on."""
    found, index = np.unique(keys, return_inverse=True)
    return names + index, names + len(found)


def _joined(a: np.ndarray, b: np.ndarray, names: int) -> np.ndarray:
    """Two numbers below ``names`` and 2**32 in one."""
    return a.astype(np.int64) * np.int64(max(names, int(b.max(initial=0)) + 1)) + b


class Grammar:
    """The levels above ``symbols``, numbers from 0. The first and the last symbol must be there
    once only: extensions stop at them."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[Level] = []
        symbols = symbols.astype(np.int64)
        names = int(symbols.max(initial=0)) + 1
        blocks = True
        while len(symbols) > 1:
            first, over, names = (self._blocks if blocks else self._pairs)(symbols, names)
            if len(first) <= len(symbols):
                parent = np.zeros(len(symbols), dtype=np.int32)
                parent[first[1:-1]] = 1
                parent = np.cumsum(parent, dtype=np.int32)
                self.levels.append(Level(symbols, blocks, parent, first))
                symbols = over
            blocks = not blocks

    @staticmethod
    def _blocks(symbols, names):
        opens = np.append(True, symbols[1:] != symbols[:-1])
        first = np.append(np.flatnonzero(opens), len(symbols)).astype(np.int32)
        length = np.diff(first)
        over = symbols[first[:-1]].copy()
        long = length > 1
        if long.any():
            over[long], names = _named(_joined(over[long], length[long], names), names)
        return first, over, names

    @staticmethod
    def _pairs(symbols, names):
        best, most, seed = None, 0, 0
        # Neighbours differ, so a random split makes pairs of a quarter of them on average.
        while seed < SPLITS or 5 * most < len(symbols) - 1:
            is_left = (mixed(symbols.view(np.uint64), seed) & np.uint64(1)).astype(bool)
            for left in (is_left, ~is_left):
                found = left[:-1] & ~left[1:]
                count = int(np.count_nonzero(found))
                if count > most:
                    best, most = found, count
            seed += 1
        second = np.append(False, best)
        first = np.append(np.flatnonzero(~second), len(symbols)).astype(np.int32)
        over = symbols[first[:-1]].copy()
        paired = np.append(best, False)[first[:-1]]
        at = first[:-1][paired]
        over[paired], names = _named(_joined(symbols[at], symbols[at + 1], names), names)
        return first, over, names

    def extend(self, i: np.ndarray, j: np.ndarray, step: int = 1) -> np.ndarray:
        """How many symbols from ``i`` and from ``j`` on are the same, to the right (``step`` 1)
        or to the left (-1), with those at ``i`` and ``j``. ``i`` and ``j`` differ."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        stopped = np.zeros(len(a), dtype=np.int16)
        active = np.arange(len(a))
        for height, level in enumerate(self.levels):
            x, y = a[active], b[active]
            same = level.symbols[x] == level.symbols[y]
            stopped[active[~same]] = height
            active, x, y = active[same], x[same], y[same]
            if not len(active):
                break
            px, py = level.parent[x], level.parent[y]
            rx, ry = _rest(level, x, px, step), _rest(level, y, py, step)
            ex = x == _edge(level, px, step)
            ey = y == _edge(level, py, step)
            # Both at the edge of a parent climb; others first take what is left of the parents.
            climbs = ex & ey
            if level.blocks:
                by = np.where(climbs, 0, np.minimum(rx, ry))
                climbs |= rx == ry
            else:
                by = np.where(climbs, 0, 1)
                climbs[:] = True
            x, y = x + step * by, y + step * by
            a[active], b[active] = x, y
            stopped[active[~climbs]] = height
            # A difference right after the step is found one level up, at the new edges.
            active, x, y = active[climbs], x[climbs], y[climbs]
            a[active], b[active] = level.parent[x], level.parent[y]
        for height in range(int(stopped.max(initial=0)) - 1, -1, -1):
            level = self.levels[height]
            down = np.flatnonzero(stopped > height)
            px, py = a[down], b[down]
            x, y = _edge(level, px, step), _edge(level, py, step)
            rx, ry = level.first[px + 1] - level.first[px], level.first[py + 1] - level.first[py]
            same = level.symbols[x] == level.symbols[y]
            by = np.where(same, np.minimum(rx, ry), 0)
            if not level.blocks:
                by = np.minimum(by, 1)
            a[down], b[down] = x + step * by, y + step * by
        return (a - i) * step


def _edge(level: Level, parent: np.ndarray, step: int) -> np.ndarray:
    """The symbol of a parent that is met first in a direction."""
    return level.first[parent].astype(np.int64) if step > 0 else level.first[parent + 1].astype(np.int64) - 1


def _rest(level: Level, at: np.ndarray, parent: np.ndarray, step: int) -> np.ndarray:
    """Symbols of the parent that are left in a direction, with the one at ``at``."""
    return level.first[parent + 1] - at if step > 0 else at - level.first[parent] + 1
