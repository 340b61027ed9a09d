"""Forests of delivery functions: heavy paths, segment trees over them, prefixes of all paths.

A delivery function gives the second at which a turn is delivered from the second at which its
parent is.  It is piecewise `slope * t + add` with slope 0 or 1 over 0 <= t <= NEVER; NEVER stands
for "not delivered" and stays so.  Functions lie one after another in flat arrays, so a step
composes or evaluates any number of them at once.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import spread

#: The second of what is never delivered; all real seconds lie below half of it.
NEVER = 1 << 41
#: An attempt comes so many seconds after the first.
WAITS = np.array([0, 20, 60, 140, 300, 620])


class Functions:
    """Functions k = 0, 1, ...: pieces off[k] .. off[k + 1] with their first t, slope and add; the first starts at 0, the last at NEVER."""

    def __init__(self, counts: np.ndarray, at: np.ndarray, slope: np.ndarray, add: np.ndarray):
        self.off = np.concatenate([[0], np.cumsum(counts)])
        self.at, self.slope, self.add = at, slope, add
        self.keys = (np.repeat(np.arange(len(counts)), counts) << 42) | at

    def __len__(self) -> int:
        return len(self.off) - 1

    def piece(self, k: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, (k << 42) | t, "right") - 1

    def __call__(self, k: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Value of function k at t, item by item."""
        p = self.piece(k, t)
        return self.slope[p] * t + self.add[p]

    def take(self, k: np.ndarray) -> Functions:
        counts = self.off[k + 1] - self.off[k]
        rows = spread(self.off[k], counts)
        return Functions(counts, self.at[rows], self.slope[rows], self.add[rows])


def joined(owner: np.ndarray, m: int, at: np.ndarray, slope: np.ndarray, add: np.ndarray) -> Functions:
    """Functions from pieces in order; a piece that goes on as the one before it melts into that."""
    keep = np.ones(len(at), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (slope[1:] != slope[:-1]) | (add[1:] != add[:-1]) | (at[1:] == NEVER)
    return Functions(np.bincount(owner[keep], minlength=m), at[keep], slope[keep], add[keep])


def identity(m: int) -> Functions:
    return Functions(np.full(m, 2), np.tile([0, NEVER], m), np.tile([1, 0], m), np.tile([0, NEVER], m))


def composed(f: Functions, i: np.ndarray, g: Functions, j: np.ndarray) -> Functions:
    """g[j] after f[i], item by item."""
    counts = f.off[i + 1] - f.off[i]
    p = spread(f.off[i], counts)
    owner = np.repeat(np.arange(len(i)), counts)
    end = np.full(len(p), NEVER + 1)
    end[:-1] = np.where(owner[1:] == owner[:-1], f.at[p[1:]], NEVER + 1)
    low = f.slope[p] * f.at[p] + f.add[p]
    high = np.where(f.slope[p] == 1, np.maximum(low, np.minimum(end - 1 + f.add[p], NEVER - 1)), low)
    first = g.piece(j[owner], low)
    n = g.piece(j[owner], high) - first + 1
    q, back = spread(first, n), np.repeat(np.arange(len(p)), n)
    s, a = f.slope[p][back], f.add[p][back]
    start = np.maximum(f.at[p][back], np.where(s == 1, g.at[q] - a, 0))
    return joined(owner[back], len(i), start, s * g.slope[q], g.add[q] + g.slope[q] * a)


def first_attempt(start: np.ndarray, ready: np.ndarray, fails: np.ndarray) -> np.ndarray:
    """Number of the attempt that delivers, 7 for none: not before ready, and its bit in fails isn't set."""
    good = (start[:, None] + WAITS >= ready[:, None]) & ((fails[:, None] >> np.arange(6)) & 1 == 0)
    return np.where(good.any(1), good.argmax(1) + 1, 7)


def delivery(arrival: np.ndarray, ready: np.ndarray, fails: np.ndarray) -> Functions:
    """The delivery function of each turn: attempts begin at its arrival or its parent's delivery, if later."""
    n = len(arrival)
    low = np.stack([arrival, *(np.maximum(arrival, ready - w) for w in WAITS[::-1])], 1)  # what start changes the attempt
    a = first_attempt(low.ravel(), np.repeat(ready, 7), np.repeat(fails, 7)).reshape(n, 7)
    wait = np.append(WAITS, NEVER)[a - 1]
    slope = (a < 7).astype(np.int64)
    at = np.concatenate([np.zeros((n, 1), np.int64), low, np.full((n, 1), NEVER)], 1)
    slope = np.concatenate([np.zeros((n, 1), np.int64), slope, np.zeros((n, 1), np.int64)], 1)
    add = np.concatenate([np.where(a[:, :1] < 7, arrival[:, None] + wait[:, :1], NEVER), wait, np.full((n, 1), NEVER)], 1)
    keep = np.ones(at.shape, bool)
    keep[:, :-1] = at[:, :-1] < at[:, 1:]  # of pieces that start together the last one holds
    owner = np.repeat(np.arange(n), keep.sum(1))
    return joined(owner, n, at[keep], slope[keep], add[keep])


class Forest:
    """Heavy paths of a forest given by each node's parent (-1: a root), which comes before the node."""

    def __init__(self, parent: np.ndarray):
        n = len(parent)
        self.parent = parent
        inner = np.flatnonzero(parent >= 0)
        self.depth = self._sum_above(parent >= 0, parent)
        size = np.ones(n, np.int64)
        by_depth = inner[np.argsort(-self.depth[inner], kind="stable")]
        for level in np.split(by_depth, np.flatnonzero(np.diff(self.depth[by_depth])) + 1):
            np.add.at(size, parent[level], size[level])
        ranked = inner[np.lexsort((inner, -size[inner], parent[inner]))]
        heavy = ranked[np.append(True, parent[ranked[1:]] != parent[ranked[:-1]])] if len(ranked) else ranked
        self.head = np.arange(n)
        self.head[heavy] = parent[heavy]
        while True:
            further = self.head[self.head]
            if (further == self.head).all():
                break
            self.head = further
        light = parent >= 0
        light[heavy] = False
        self.light = self._sum_above(light, parent)
        self.at = self.depth - self.depth[self.head]  # place in its path
        self.order = np.lexsort((self.depth, self.head))  # paths one after another
        heads = self.order[self.at[self.order] == 0]
        self.heads = heads
        self.path = np.zeros(n, np.int64)  # number of each node's path
        self.path[heads] = np.arange(len(heads))
        self.path = self.path[self.head]
        self.length = np.bincount(self.path, minlength=len(heads))

    @staticmethod
    def _sum_above(mark: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """How many of a node and those above it are marked."""
        total, up = mark.astype(np.int64), np.where(parent >= 0, parent, -1)
        while (up >= 0).any():
            total = total + np.where(up >= 0, total[up], 0)
            up = np.where(up >= 0, up[up], -1)
        return total


class PathTrees:
    """A segment tree of composed delivery functions over each heavy path."""

    def __init__(self, forest: Forest, leaves: Functions):
        self.forest = forest
        self.levels, self.sizes = [leaves.take(forest.order)], [forest.length]
        while len(forest.length) and self.sizes[-1].max() > 1:
            below, n = self.levels[-1], self.sizes[-1]
            base = np.cumsum(n) - n
            up = (n + 1) // 2
            left = spread(np.zeros(len(n), np.int64), up) * 2 + np.repeat(base, up)
            alone = np.ones(len(left), bool)
            alone[:] = left + 1 >= np.repeat(base + n, up)
            nothing = identity(1)
            both = composed(below, left[~alone], below, left[~alone] + 1)
            single = composed(below, left[alone], nothing, np.zeros(int(alone.sum()), np.int64))
            self.levels.append(merged(both, single, alone))
            self.sizes.append(up)
        self.base = [np.cumsum(n) - n for n in self.sizes]

    def prefix(self, node: np.ndarray) -> Functions:
        """The function of each node's path from its head through the node."""
        path, n = self.forest.path[node], self.forest.at[node] + 1
        out, done = identity(len(node)), np.zeros(len(node), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            has = (n >> k) & 1 == 1
            if has.any():
                i = np.flatnonzero(has)
                step = composed(out, i, self.levels[k], self.base[k][path[i]] + (done[i] >> k))
                out = merged(out.take(np.flatnonzero(~has)), step, has)
                done[i] += 1 << k
        return out

    def to_root(self, node: np.ndarray) -> Functions:
        """The function of each node's whole way from its root, by the prefixes of the paths that it crosses."""
        acc, here = identity(len(node)), node.copy()
        while (here >= 0).any():
            i = np.flatnonzero(here >= 0)
            step = composed(self.prefix(here[i]), np.arange(len(i)), acc, i)
            acc = merged(acc.take(np.flatnonzero(here < 0)), step, here >= 0)
            here[i] = self.forest.parent[self.forest.head[here[i]]]
        return acc

    def starts(self, given: np.ndarray) -> np.ndarray:
        """The parent's delivery second of each node; given holds it for roots.  Light edges from the top
        down; the prefixes of all paths of one height are evaluated together down their trees."""
        f = self.forest
        out = np.zeros(len(f.parent), np.int64)
        value = np.zeros(len(f.parent), np.int64)
        for level in range(int(f.light.max(initial=-1)) + 1):
            paths = np.flatnonzero(f.light[f.heads] == level)
            above = f.parent[f.heads[paths]]
            t = np.where(above >= 0, value[above], given[f.heads[paths]])
            for k in range(len(self.levels) - 1, 0, -1):
                n = self.sizes[k - 1][paths]
                left = spread(np.zeros(len(paths), np.int64), self.sizes[k][paths]) * 2
                owner = np.repeat(np.arange(len(paths)), self.sizes[k][paths])
                has = left + 1 < n[owner]
                right = self.levels[k - 1](self.base[k - 1][paths[owner]] + left, t)
                both = np.stack([t, right], 1).ravel()
                t = both[np.stack([np.ones(len(has), bool), has], 1).ravel()]
            nodes = f.order[spread(self.base[0][paths], f.length[paths])]
            out[nodes] = t
            value[nodes] = self.levels[0](spread(self.base[0][paths], f.length[paths]), t)
        return out


def merged(a: Functions, b: Functions, is_b: np.ndarray) -> Functions:
    """Functions of a and b in turn, b where is_b says so."""
    place = np.where(is_b, len(a) + np.cumsum(is_b) - 1, np.cumsum(~is_b) - 1)
    both = Functions(np.concatenate([np.diff(a.off), np.diff(b.off)]), np.concatenate([a.at, b.at]), np.concatenate([a.slope, b.slope]), np.concatenate([a.add, b.add]))
    return both.take(place)
