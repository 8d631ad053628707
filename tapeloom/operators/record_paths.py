"""New volume in many overlapping windows of one series, without pairing polls with windows.

Cumulative volume only counts where it passes its highest value since a window opened. The polls that do so form a
path: from the first usable poll to the next one with more volume, and so on. These steps depend on the poll alone, not
on the window, so all windows share one forest, in which sums along a path are differences and the first poll that
fulfils a condition is found by doubling steps. A series of n polls takes n log n numbers, however the windows overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SLACK = 1e-9  # of the compared sums: nodes found within it are tried with the exact condition


@dataclass
class Decisions:
    """Per window: the row that decided (-1: none passed), and the sums up to it or to the window's end."""

    row: np.ndarray
    up: np.ndarray
    down: np.ndarray


def _next_greater(volume: np.ndarray) -> np.ndarray:
    """Place of the next strictly greater value; the length where there is none."""
    out, open_, values = [len(volume)] * len(volume), [], volume.tolist()
    for i, v in enumerate(values):
        while open_ and values[open_[-1]] < v:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, dtype=np.int64)


class Forest:
    """Usable polls in order: ``volume`` cumulative, ``last`` price, ``side`` 1 up, -1 down, 0 by the tick rule."""

    def __init__(self, volume: np.ndarray, last: np.ndarray, side: np.ndarray):
        n = len(volume)
        before = np.concatenate([[np.nan], last[:-1]])[:n]
        share = np.select([side > 0, side < 0, last > before, last < before], [1.0, 0.0, 1.0, 0.0], 0.5)
        after = _next_greater(volume)
        parent = np.minimum(after, max(n - 1, 0))
        gain = np.where(after < n, volume[parent] - volume, 0.0)
        ups, downs, way = [0.0] * (n + 1), [0.0] * (n + 1), after.tolist()
        up_gain, down_gain = (gain * share[parent]).tolist(), (gain * (1.0 - share[parent])).tolist()
        for i in range(n - 1, -1, -1):
            ups[i], downs[i] = ups[way[i]] + up_gain[i], downs[way[i]] + down_gain[i]
        self.n, self.volume = n, np.append(volume, np.inf)
        self.up, self.down = np.array(ups), np.array(downs)
        self.steps = [np.append(after, n)]
        while (self.steps[-1] < n).any():
            self.steps.append(self.steps[-1][self.steps[-1]])

    def advance(self, start: np.ndarray, may: list[np.ndarray] | None, bound: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Furthest node of each path up to which all nodes after the start stay below the bound: by ``value``, which
        rises along paths, or by ``may``, minima of what must stay above it over the nodes of each doubling step."""
        at = start.copy()
        for k in range(len(self.steps) - 1, -1, -1):
            to = self.steps[k][at]
            go = (to < self.n) & ((may[k][at] > bound) if may is not None else (value[to] < bound))
            at = np.where(go, to, at)
        return at

    def minima(self, value: np.ndarray) -> list[np.ndarray]:
        out = [value[self.steps[0]]]
        for k in range(1, len(self.steps)):
            out.append(np.minimum(out[-1], out[-1][self.steps[k - 1]]))
        return out


def decide(volume: np.ndarray, last: np.ndarray, side: np.ndarray, first: np.ndarray, end: np.ndarray, base: np.ndarray,
           need: float, share: float) -> Decisions:
    """Decide windows over rows ``first`` up to before ``end`` of one ordered series (volume NaN: failed poll).

    A window passes at the first row where volume / base >= need (a base of 0 or less or NaN never does) and
    up / volume >= share (a volume of 0 counts as share 0).
    """
    usable = np.flatnonzero(~np.isnan(volume))
    f = Forest(volume[usable], last[usable], side[usable])
    start, stop = np.searchsorted(usable, first), np.searchsorted(usable, end)
    row, up, down = np.full(len(first), -1), np.zeros(len(first)), np.zeros(len(first))
    has = np.flatnonzero(start < stop)
    place = np.arange(f.n + 1, dtype=np.float64)
    if len(has):
        a = start[has]
        at = f.advance(a, None, stop[has].astype(np.float64), place)
        up[has], down[has] = f.up[a] - f.up[at], f.down[a] - f.down[at]
    if need <= 0 and share <= 0:  # met before any new volume
        now = (base > 0) & (first < end)
        return Decisions(np.where(now, first, row), np.where(now, 0.0, up), np.where(now, 0.0, down))
    live = np.flatnonzero((start < stop) & (base > 0))
    if not len(live) or not f.n:
        return Decisions(row, up, down)
    shift = f.volume[:-1].min()
    level = f.up + share * (np.append(f.volume[:-1], shift) - shift)  # up / volume >= share where it is no higher than at the start
    lows = f.minima(level)
    slack = SLACK * (1.0 + np.abs(level).max())
    wanted = need * base[live]
    goal = f.volume[start[live]] + wanted - SLACK * (1.0 + np.abs(f.volume[start[live]]) + np.abs(wanted))
    at = f.advance(start[live], None, goal, f.volume)
    while len(live):
        at = f.advance(at, lows, level[start[live]] + slack, level)
        at = f.steps[0][at]
        inside = at < stop[live]
        live, at = live[inside], at[inside]
        u, d = f.up[start[live]] - f.up[at], f.down[start[live]] - f.down[at]
        total = u + d
        passed = (total / base[live] >= need) & (np.divide(u, total, out=np.zeros(len(u)), where=total > 0) >= share)
        won = live[passed]
        row[won], up[won], down[won] = usable[at[passed]], u[passed], d[passed]
        live, at = live[~passed], at[~passed]
    return Decisions(row, up, down)
