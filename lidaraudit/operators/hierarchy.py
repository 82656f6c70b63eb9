"""Density clusters of one frame's points at all densities (HDBSCAN), on arrays.

Two points are as far apart as the largest of their distance and their core distances, the
distance to the min_samples-th point, itself included. The minimum spanning tree of these distances (see spanning) gives the
hierarchy; splits that leave at least min_cluster_size points on both sides make clusters, other points fall out.
Either the leaves of the tree of clusters are taken, or those of greatest excess of mass.
(Campello, Moulavi and Sander 2013; McInnes and Healy 2017.)
"""

from __future__ import annotations

import numpy as np

from lidaraudit.operators import spanning

def merges(start: np.ndarray, stop: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree bottom up: row i joins two nodes to node n + i; left and right node, distance, in order of distance."""
    order = np.argsort(length, kind="stable")
    n = len(order) + 1
    parent = list(range(2 * n - 1))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    children = np.zeros((n - 1, 2), np.int64)
    for i, e in enumerate(order.tolist()):
        a, b = top(int(start[e])), top(int(stop[e]))
        children[i] = a, b
        parent[a] = parent[b] = n + i
    return children[:, 0], children[:, 1], length[order]


def hdbscan(points: np.ndarray, min_cluster_size: int, min_samples: int, selection: str = "leaf") -> tuple[np.ndarray, np.ndarray]:
    """Label of each point (-1: noise), numbered by least point, and how sure it is (0 to 1)."""
    n = len(points)
    if n < max(min_samples, 2):
        return np.full(n, -1), np.zeros(n)
    return labels(*spanning.tree(points, spanning.core_distances(points, min_samples)), min_cluster_size, selection)


def labels(start: np.ndarray, stop: np.ndarray, length: np.ndarray, min_cluster_size: int, selection: str = "leaf") -> tuple[np.ndarray, np.ndarray]:
    """hdbscan() from the edges of the spanning tree, in order."""
    n = len(length) + 1
    left, right, length = merges(start, stop, length)
    size = np.ones(2 * n - 1, np.int64)
    for i in range(n - 1):
        size[n + i] = size[left[i]] + size[right[i]]
    density = 1.0 / np.maximum(length, 1e-300)
    density[length == 0] = np.inf

    # Top down: which cluster a node belongs to, at which density its points leave that, and when clusters begin.
    parent_of, birth, mass, death = [-1], [0.0], [0.0], [0.0]
    leaves_at, cluster_of = np.zeros(n), np.zeros(n, np.int64)
    stack = [(2 * n - 2, 0)]
    while stack:
        node, cluster = stack.pop()
        if node < n:  # alone in what was left of its cluster
            leaves_at[node], cluster_of[node] = death[cluster], cluster
            continue
        a, b, at = int(left[node - n]), int(right[node - n]), float(density[node - n])
        gone = [x for x in (a, b) if size[x] < min_cluster_size]
        death[cluster] = max(death[cluster], at)
        if len(gone) == 0:
            mass[cluster] += (at - birth[cluster]) * size[node] if np.isfinite(at) else 0.0
            for x in (a, b):
                parent_of.append(cluster)
                birth.append(at)
                mass.append(0.0)
                death.append(at)
                stack.append((x, len(birth) - 1))
            continue
        for x in gone:
            mass[cluster] += (at - birth[cluster]) * size[x] if np.isfinite(at) else 0.0
            below = [x]
            while below:
                y = below.pop()
                if y < n:
                    leaves_at[y], cluster_of[y] = at, cluster
                else:
                    below += [int(left[y - n]), int(right[y - n])]
        stack += [(x, cluster) for x in (a, b) if x not in gone]

    taken = _selected(parent_of, mass, selection)
    owner = np.full(len(birth), -1)  # the taken cluster that a cluster lies in
    for c in range(1, len(birth)):
        owner[c] = c if taken[c] else owner[parent_of[c]]
    own = owner[cluster_of]
    label, sure = np.full(n, -1), np.zeros(n)
    inside = own >= 0
    kinds, first, number = np.unique(own[inside], return_index=True, return_inverse=True)
    label[inside] = np.argsort(np.argsort(first))[number]
    last = np.array(death)[own[inside]]
    whole = ~np.isfinite(leaves_at[inside]) | (last == 0) | ~np.isfinite(last)
    sure[inside] = np.where(whole, 1.0, np.minimum(leaves_at[inside], last) / np.where(whole, 1.0, last))
    return label, sure


def _selected(parent_of: list[int], mass: list[float], selection: str) -> list[bool]:
    """Which clusters are taken; the whole (cluster 0) never is."""
    has_child = [False] * len(parent_of)
    for p in parent_of[1:]:
        has_child[p] = True
    if selection == "leaf":
        return [c > 0 and not has_child[c] for c in range(len(parent_of))]
    best, below = list(mass), [0.0] * len(parent_of)
    own = [False] * len(parent_of)
    for c in range(len(parent_of) - 1, 0, -1):  # children come after their parents
        own[c] = mass[c] >= below[c]
        best[c] = max(mass[c], below[c])
        below[parent_of[c]] += best[c]
    inside = [False] * len(parent_of)
    for c in range(1, len(parent_of)):  # nothing within a taken cluster is taken
        inside[c] = inside[parent_of[c]] or own[parent_of[c]]
        own[c] = own[c] and not inside[c]
    return own
