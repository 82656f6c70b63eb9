"""Connected components on arrays, and of grid cells that touch."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges a-b, and the least node of the component of each."""
    nodes, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = number[: len(a)], number[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


#: What spreads the coordinates of a cell over one number. Cells that share it count as touching.
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def touching_cells(cells: np.ndarray) -> np.ndarray:
    """The part of each cell (rows of whole numbers): cells that touch, also at a corner, are in one part."""
    if not len(cells):
        return np.zeros(0, np.int64)
    width = cells.shape[1]
    code = lambda c: (c.astype(np.int64).view(np.uint64) * SPREAD[:width]).sum(1, dtype=np.uint64)
    kinds, number = np.unique(code(cells), return_inverse=True)
    a, b = [np.arange(len(kinds))], [np.arange(len(kinds))]
    for step in itertools.product((-1, 0, 1), repeat=width):
        if step > (0,) * width:  # the others are the same pairs from the other side
            other = code(cells + np.array(step))
            at = np.minimum(np.searchsorted(kinds, other), len(kinds) - 1)
            there = kinds[at] == other
            a.append(number[there])
            b.append(at[there])
    _, root = roots(np.concatenate(a), np.concatenate(b))
    return root[number]


def cells_of(points: np.ndarray, side: float) -> np.ndarray:
    """The grid cell of each point (rows of coordinates)."""
    return np.floor(points / side).astype(np.int64)


def cell_codes(cells: np.ndarray) -> np.ndarray:
    return (cells.view(np.uint64) * SPREAD[: cells.shape[1]]).sum(1, dtype=np.uint64)


def neighbours(cells: np.ndarray) -> np.ndarray:
    """Codes of each cell and of those that touch it, a column for each step."""
    return np.stack([cell_codes(cells + np.array(s)) for s in itertools.product((-1, 0, 1), repeat=cells.shape[1])], 1)


class Cells:
    """Points (rows of coordinates) by grid cell of a side, to be met by others."""

    #: Pairs that pairs() gives at once, as long as one point has no more.
    MOST = 2_000_000

    def __init__(self, points: np.ndarray, side: float) -> None:
        self.side = side
        code = cell_codes(cells_of(points, side))
        self.order = np.argsort(code, kind="stable")
        self.codes = code[self.order]

    def pairs(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of points and of own points in the same cell or in one that touches it, in chunks that end with a point."""
        if not len(points) or not len(self.codes):
            return
        steps = neighbours(cells_of(points, self.side))
        low = np.searchsorted(self.codes, steps, "left")
        many = np.searchsorted(self.codes, steps, "right") - low
        ends = np.cumsum(many.sum(1))
        at = 0
        while at < len(points):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.MOST, "right")))
            n, first = many[at:to].ravel(), low[at:to].ravel()
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            yield np.repeat(np.arange(at, to), many[at:to].sum(1)), self.order[place]
            at = to
