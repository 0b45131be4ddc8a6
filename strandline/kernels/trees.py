"""Guide trees from distances. A tree is a list of (left, right, left length, right length); nodes 0..n-1 are
leaves and node n + i is the i-th entry."""

from __future__ import annotations

import re

import numpy as np

#: Leaves above which neighbour joining gives way to average linkage.
MOST_JOINED = 2000
Tree = list[tuple[int, int, float, float]]


def square(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    out = np.zeros((n, n))
    out[i, j] = out[j, i] = d
    return out


def neighbor_joining(dist: np.ndarray) -> Tree:
    """The first pair with the least Q joins; a negative branch is moved to its sister and then cut at 0."""
    n = len(dist)
    d = dist.astype(float).copy()
    active, node, tree = list(range(n)), list(range(n)), []
    while len(active) > 2:
        k = len(active)
        sub = d[np.ix_(active, active)]
        r = sub.sum(1)
        q = (k - 2) * sub - r[:, None] - r[None, :]
        q[np.tril_indices(k)] = np.inf
        x, y = divmod(int(np.argmin(q)), k)
        dxy = sub[x, y]
        lx = dxy / 2 + (r[x] - r[y]) / (2 * (k - 2))
        ly = dxy - lx
        if lx < 0:
            lx, ly = 0.0, ly + lx
        if ly < 0:
            lx, ly = lx + ly, 0.0
        i, j = active[x], active[y]
        tree.append((node[i], node[j], max(0.0, float(lx)), max(0.0, float(ly))))
        new = (d[i, :] + d[j, :] - dxy) / 2
        d[i, :] = d[:, i] = new
        d[i, i] = 0
        node[i] = n + len(tree) - 1
        active.remove(j)
    if len(active) == 2:
        i, j = active
        tree.append((node[i], node[j], float(d[i, j]) / 2, float(d[i, j]) / 2))
    return tree


def upgma(dist: np.ndarray) -> Tree:
    """The first closest pair joins; distances are means over members, branches reach to half the distance."""
    n = len(dist)
    d = dist.astype(float).copy()
    active, node, size, height, tree = list(range(n)), list(range(n)), [1] * n, [0.0] * n, []
    while len(active) > 1:
        sub = d[np.ix_(active, active)].copy()
        sub[np.tril_indices(len(active))] = np.inf
        x, y = divmod(int(np.argmin(sub)), len(active))
        i, j = active[x], active[y]
        h = d[i, j] / 2
        tree.append((node[i], node[j], float(max(0.0, h - height[i])), float(max(0.0, h - height[j]))))
        d[i, :] = d[:, i] = (size[i] * d[i, :] + size[j] * d[j, :]) / (size[i] + size[j])
        d[i, i] = 0
        size[i] += size[j]
        height[i], node[i] = h, n + len(tree) - 1
        active.remove(j)
    return tree


def build(dist: np.ndarray, method: str = "nj") -> Tree:
    return neighbor_joining(dist) if method == "nj" and len(dist) <= MOST_JOINED else upgma(dist)


def leaves_below(tree: Tree, n: int) -> list[list[int]]:
    out = [[i] for i in range(n)]
    for a, b, _, _ in tree:
        out.append(out[a] + out[b])
    return out


def depths(tree: Tree, n: int) -> list[int]:
    """Steps from the root to each node."""
    out = [0] * (n + len(tree))
    for k in range(len(tree) - 1, -1, -1):
        for c in tree[k][:2]:
            out[c] = out[n + k] + 1
    return out


def weights(tree: Tree, n: int) -> np.ndarray:
    """For each leaf, the branches on its way to the root, each shared among the leaves below it; mean 1."""
    below = leaves_below(tree, n)
    w = np.zeros(n)
    for a, b, la, lb in tree:
        for c, length in ((a, la), (b, lb)):
            w[below[c]] += length / len(below[c])
    return np.maximum(w / w.mean(), 1e-4) if w.sum() > 0 else np.ones(n)


def newick(tree: Tree, names: list[str]) -> str:
    n = len(names)
    label = [re.sub(r"[\s()\[\]{}:;,'\"]", "_", s) or f"seq{i}" for i, s in enumerate(names)]
    for a, b, la, lb in tree:
        label.append(f"({label[a]}:{la:.5f},{label[b]}:{lb:.5f})")
    return (label[-1] if label else "") + ";"
