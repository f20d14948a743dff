"""Signature trees over sets of 64-bit tokens: which sets are alike, found by dual traversal.

A leaf holds one set as a bitmap of its tokens and its size; a node the OR of its children's bitmaps and the range
of their sizes. From those follows the most that any set below one node can share with any set below another; node pairs that
cannot reach the threshold are dropped whole, and so are pairs whose sets are all known to hang together.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union; both are sorted and without repeats."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a)) if len(b) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


class SignatureTree:
    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        sizes = np.array([len(s) for s in sets], np.int64)
        bits = 1 << max(8, min(16, int(np.ceil(np.log2(4 * max(1, int(np.median(sizes))))))))
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            at = (s & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        slack = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)  # tokens that may hide behind another's bit
        self.levels = [(maps, sizes, sizes, slack)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            cuts = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(slack, cuts)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs of nodes may hold sets that are alike."""
        maps, low, high, slack = self.levels[level]
        p = self.percent
        out = (100 * high[i] >= p * low[j]) & (100 * high[j] >= p * low[i])
        keep = np.flatnonzero(out)
        i, j = i[keep], j[keep]
        ok = np.zeros(len(keep), bool)
        for a in range(0, len(keep), 4096):
            s = slice(a, a + 4096)
            shared = np.bitwise_count(maps[i[s]] & maps[j[s]]).sum(1).astype(np.int64)
            most = np.minimum(np.minimum(slack[i[s]], slack[j[s]]) + shared, np.minimum(high[i[s]], high[j[s]]))
            ok[s] = (100 + p) * most >= p * (low[i[s]] + low[j[s]])  # 100 o >= p (x + y - o)
        out[keep] = ok
        return out


def link(sets: list[np.ndarray], classes: np.ndarray, percent: int) -> np.ndarray:
    """The class of each set once all classes with alike members are joined (the least class of those joined).

    ``classes`` are those known before. Pairs within a class, known or joined meanwhile, aren't compared: they change nothing.
    """
    n = len(sets)
    root = np.asarray(classes).copy()
    if n < 2 or (root == root[0]).all():
        return root
    order = np.lexsort(([len(s) for s in sets], root))  # a class's sets lie together, and near others of their size
    root = root[order]
    tree = SignatureTree([sets[k] for k in order], percent)
    top = len(tree.levels) - 1
    i = j = np.zeros(1, np.int64)
    for level in range(top, 1, -1):  # pairs i <= j of nodes, from the root down to the parents of leaves
        i, j = _children(tree, level, i, j, root)
    if top == 0:
        return root
    for a, b in zip(i.tolist(), j.tolist()):
        xs = range(a * FANOUT, min(n, (a + 1) * FANOUT))
        left, right = root[xs.start : xs.stop], root[b * FANOUT : (b + 1) * FANOUT]
        if (left == left[0]).all() and (right == left[0]).all():
            continue
        for x in xs:
            ys = np.arange(max(x + 1, b * FANOUT), min(n, (b + 1) * FANOUT))
            ys = ys[root[ys] != root[x]]
            if len(ys):
                ys = ys[tree.possible(0, np.full(len(ys), x), ys)]
            for y in ys.tolist():
                if root[y] != root[x] and alike(tree.sets[x], tree.sets[y], percent):
                    lo, hi = sorted((root[x], root[y]))
                    root[root == hi] = lo
    out = np.empty_like(root)
    out[order] = root
    return out


def _children(tree: SignatureTree, level: int, i: np.ndarray, j: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The possible pairs of children, one level down, of the pairs of nodes; in parts, so that few are held before pruning."""
    below = len(tree.levels[level - 1][0])
    width = FANOUT ** (level - 1)
    starts = np.arange(0, len(root), width)
    low, high = np.minimum.reduceat(root, starts), np.maximum.reduceat(root, starts)
    found_i, found_j = [], []
    step = np.arange(FANOUT)
    for s in range(0, len(i), 8192):
        a = (i[s : s + 8192, None, None] * FANOUT + step[:, None]).repeat(FANOUT, 2).ravel()
        b = (j[s : s + 8192, None, None] * FANOUT + step[None, :]).repeat(FANOUT, 1).ravel()
        ok = (a < below) & (b < below) & (a <= b)
        a, b = a[ok], b[ok]
        ok = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        a, b = a[ok], b[ok]
        same = a == b
        ok = same | tree.possible(level - 1, a, b)
        found_i.append(a[ok])
        found_j.append(b[ok])
    return np.concatenate(found_i), np.concatenate(found_j)
