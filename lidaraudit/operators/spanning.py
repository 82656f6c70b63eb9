"""Minimum spanning trees of mutual reachability without all distances: blocks of a frame, each with what is near it.

Two points are as far apart as the largest of their distance and their core distances. Edges are ordered by
(distance, lesser point, greater point), so that there is one minimum spanning tree, however it is found.

What makes it local: an edge of the tree that is no longer than REACH is in the tree of any set of points that holds its
ends. So each block's own tree over its points and those within reach holds all edges of the whole tree
that begin in the block and are no longer; the tree is in the union of these. What is left apart by then
is joined over twice the reach, and so on: only points outside the largest part ask then, since every edge between parts has
such an end. Core distances are found alike: a point whose k-th neighbour is within reach is done.

The same functions work on a frame within one task (tree()) and on blocks that Spark deals out (see cluster.hdbscan).
"""

from __future__ import annotations

import numpy as np

#: Points of a block that the sides of blocks aim at; blocks are this many times as long as the reach.
BLOCK_POINTS, SIDES_PER_REACH = 700, 8
#: Distances that are held at a time.
AT_ONCE = 1 << 21


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(sum((a[:, None, i] - b[None, :, i]) ** 2 for i in range(a.shape[1])))


def kth_nearest(asked: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """Distance of each asked point to the k-th nearest of points (itself among them); infinite if there are fewer."""
    out = np.full(len(asked), np.inf)
    if len(points) >= k:
        step = max(1, AT_ONCE // len(points))
        for a in range(0, len(asked), step):
            out[a : a + step] = np.partition(distances(asked[a : a + step], points), k - 1, axis=1)[:, k - 1]
    return out


def prim(points: np.ndarray, core: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spanning tree of a set of points: lesser and greater id, distance."""
    n = len(points)
    low, high, length = np.zeros(max(n - 1, 0), np.int64), np.zeros(max(n - 1, 0), np.int64), np.zeros(max(n - 1, 0))
    if n < 2:
        return low, high, length
    # What is outside the tree stands in the first m places of these; `at` goes in, the last one takes its place.
    x, y, z = (points[1:, i].copy() for i in range(3))
    outer, names, best, via = np.array(core)[1:], np.array(ids, np.int64)[1:], np.full(n - 1, np.inf), np.zeros(n - 1, np.int64)
    here, reach, me = points[0], core[0], int(ids[0])
    for i in range(n - 1):
        m = n - 1 - i
        d = (x[:m] - here[0]) ** 2
        d += (y[:m] - here[1]) ** 2
        d += (z[:m] - here[2]) ** 2
        np.sqrt(d, out=d)
        np.maximum(d, outer[:m], out=d)
        np.maximum(d, reach, out=d)
        old = best[:m]
        nearer = d < old
        if (same := np.flatnonzero(d == old)).size:  # equal distances go by the points
            p, q = names[same], via[same]
            a, b, c, e = np.minimum(p, q), np.maximum(p, q), np.minimum(p, me), np.maximum(p, me)
            nearer[same] = (c < a) | ((c == a) & (e < b))
        np.copyto(old, d, where=nearer)
        np.copyto(via[:m], me, where=nearer)
        at = int(old.argmin())
        least = np.flatnonzero(old == old[at])
        if len(least) > 1:
            p, q = names[least], via[least]
            at = int(least[np.lexsort((np.maximum(p, q), np.minimum(p, q)))[0]])
        here, reach, me, other = (x[at], y[at], z[at]), outer[at], int(names[at]), int(via[at])
        low[i], high[i], length[i] = min(me, other), max(me, other), old[at]
        for column in (x, y, z, outer, names, best, via):
            column[at] = column[m - 1]
    return low, high, length


def kruskal(low: np.ndarray, high: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of edges between nodes 0..n-1: places of those in the spanning forest, in order, and the part of each node (its least node)."""
    order = np.lexsort((high, low, length))
    parent = list(range(n))

    def top(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    kept = []
    for e, a, b in zip(order.tolist(), low[order].tolist(), high[order].tolist(), strict=True):
        p, q = top(a), top(b)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append(e)
    return np.array(kept, np.int64), np.array([top(v) for v in range(n)], np.int64)


def between_parts(asked: np.ndarray, points: np.ndarray, core: np.ndarray, part: np.ndarray, ids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shortest edges between parts from asked points (places in points) to all others, no longer than reach: the first of each two parts that the forest of parts needs."""
    found = []
    step = max(1, AT_ONCE // max(len(points), 1))
    for s in range(0, len(asked), step):
        own = asked[s : s + step]
        d = np.maximum(np.maximum(distances(points[own], points), core[own][:, None]), core[None, :])
        d[part[own][:, None] == part[None, :]] = np.inf
        i, j = np.nonzero(d <= reach)
        if not len(i):
            continue
        a, b, w = ids[own[i]], ids[j], d[i, j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        p, q = np.minimum(part[own[i]], part[j]), np.maximum(part[own[i]], part[j])
        order = np.lexsort((high, low, w, q, p))
        new = np.ones(len(order), bool)
        new[1:] = (p[order][1:] != p[order][:-1]) | (q[order][1:] != q[order][:-1])
        pick = order[new]
        found.append(np.rec.fromarrays([p[pick], q[pick], low[pick], high[pick], w[pick]], names="p,q,low,high,w"))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    f = np.concatenate(found).view(np.recarray)
    nodes, number = np.unique(np.concatenate([f.p, f.q]), return_inverse=True)
    order = np.lexsort((f.high, f.low, f.w))
    f, number = f[order], number.reshape(2, -1)[:, order]
    # kruskal() orders by nodes, here parts: the order of edges is given as their length.
    kept, _ = kruskal(number[0], number[1], np.arange(len(f)), len(nodes))
    return f.low[kept], f.high[kept], f.w[kept]


def reach_for(points: np.ndarray) -> float:
    """A reach at which blocks have about BLOCK_POINTS points: the longest of halves of the frame's extent at which none has more."""
    extent = float(np.ptp(points, axis=0).max(initial=0.0))
    side = extent or 1.0
    for _ in range(30):
        cells = np.floor((points - points.min(0)) / side).astype(np.int64)
        most = np.unique(cells, axis=0, return_counts=True)[1].max()
        if most <= BLOCK_POINTS:
            break
        side /= 2
    return side / SIDES_PER_REACH


def _blocks(points: np.ndarray, side: float, wanted: np.ndarray | None = None):
    """Places of the points of each block (of those wanted, if given), and of all points within reach of the block."""
    reach = side / SIDES_PER_REACH
    cells = np.floor((points - points.min(0)) / side).astype(np.int64)
    kinds, number = np.unique(cells, axis=0, return_inverse=True)
    number = number.reshape(-1)
    order = np.argsort(number, kind="stable")
    ends = np.cumsum(np.bincount(number, minlength=len(kinds)))
    by_cell = {tuple(c): order[a:b] for c, a, b in zip(kinds.tolist(), np.concatenate([[0], ends[:-1]]), ends, strict=True)}
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    for c, own in by_cell.items():
        asked = own if wanted is None else own[wanted[own]]
        if not len(asked):
            continue
        near = np.concatenate([by_cell[t] for s in steps if (t := (c[0] + s[0], c[1] + s[1], c[2] + s[2])) in by_cell])
        # Within reach of the asked points' bounds, with room for rounding.
        low, high = points[asked].min(0) - reach * 1.000001, points[asked].max(0) + reach * 1.000001
        yield asked, near[((points[near] >= low) & (points[near] <= high)).all(1)]


def core_distances(points: np.ndarray, k: int, reach: float | None = None) -> np.ndarray:
    """Distance of each point to its k-th nearest, itself included."""
    out, open_ = np.full(len(points), np.inf), np.ones(len(points), bool)
    reach = reach_for(points) if reach is None else reach
    extent = float(np.sqrt((np.ptp(points, axis=0) ** 2).sum())) if len(points) else 0.0
    while open_.any():
        last = reach > extent
        for asked, near in _blocks(points, reach * SIDES_PER_REACH, open_):
            far = kth_nearest(points[asked], points[near], k)
            done = far <= (np.inf if last else reach)
            out[asked[done]] = far[done]
            open_[asked[done]] = False
        if last:
            break
        reach *= 2
    return out


def tree(points: np.ndarray, core: np.ndarray, reach: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spanning tree of a frame's points, in order of its edges: lesser and greater point, distance."""
    n = len(points)
    if n <= BLOCK_POINTS and reach is None:
        low, high, length = prim(points, core, np.arange(n))
        order = np.lexsort((high, low, length))
        return low[order], high[order], length[order]
    reach = reach_for(points) if reach is None else reach
    edges = [prim(points[near], core[near], near) for _, near in _blocks(points, reach * SIDES_PER_REACH)]
    low, high, length = (np.concatenate(c) for c in zip(*edges, strict=True))
    near = length <= reach
    low, high, length = low[near], high[near], length[near]
    kept, part = kruskal(low, high, length, n)
    low, high, length = low[kept], high[kept], length[kept]
    while len(low) < n - 1:
        reach *= 2
        kinds, number, sizes = np.unique(part, return_inverse=True, return_counts=True)
        apart = number != sizes.argmax()
        more = [between_parts(np.searchsorted(s, a), points[s], core[s], part[s], s, reach) for a, s in ((a, np.sort(s)) for a, s in _blocks(points, reach * SIDES_PER_REACH, apart))]
        low, high, length = (np.concatenate([x, *y]) for x, y in zip((low, high, length), zip(*more, strict=True), strict=True))
        kept, part = kruskal(low, high, length, n)
        low, high, length = low[kept], high[kept], length[kept]
    return low, high, length
