"""A multiway hyperplane tree (geometric near-neighbour access tree) over integer vectors, and its elimination rule.

A node has a few split points; a vector goes to the child of the nearest one. For every split point i and child j the node
keeps the range of distances from point i to the vectors below child j, and for every child the range of their norms. A
query asks for vectors whose inner product with it lies in a window; with a child's norms this is an annulus of distances
around the query. By the triangle inequality the distance from point i to such a vector lies in a range too, and a child
whose own range doesn't meet it, for any point i, is eliminated with all that is below it.

Split points come from a bounded sample; ranges cover all vectors. Ranges are integers (squared distances); the rule
compares square roots with a margin far above their error, so it only ever keeps too much.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import vectors as V

MARGIN = 1e-7


@dataclass
class Node:
    points: np.ndarray
    children: list = field(default_factory=list)  # a leaf's number, or a Node
    number: int = 0
    low: np.ndarray | None = None   # squared distance, point x child
    high: np.ndarray | None = None
    norm_low: np.ndarray | None = None
    norm_high: np.ndarray | None = None


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` and ``b``."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * V.product(a, b)


def spread(sample: np.ndarray, m: int) -> np.ndarray:
    """Numbers of at most ``m`` rows far from each other: each next one is farthest from those chosen."""
    chosen = [0]
    nearest = squared(sample, sample[:1])[:, 0]
    while len(chosen) < m and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(sample, sample[chosen[-1:]])[:, 0])
    return np.array(chosen)


class Tree:
    def __init__(self, sample: np.ndarray, fanout: int, depth: int, least: int):
        self.nodes: list[Node] = []
        self.leaves = 0
        self.root = self._grow(sample, fanout, depth, least)

    def _grow(self, sample: np.ndarray, fanout: int, depth: int, least: int):
        chosen = spread(sample[: 8 * fanout], fanout) if depth and len(sample) > least else np.zeros(1)
        if len(chosen) < 2:
            self.leaves += 1
            return self.leaves - 1
        node = Node(sample[chosen], number=len(self.nodes))
        self.nodes.append(node)
        to = squared(sample, node.points).argmin(axis=1)
        node.children = [self._grow(sample[to == j], fanout, depth - 1, least) if (to == j).any() else self._grow(sample[:0], 0, 0, 0) for j in range(len(chosen))]
        return node

    def walk(self, x: np.ndarray):
        """(node, row numbers, squared distances to its points, child of each) of every node that rows pass, then leaves by row."""
        leaf, todo = np.zeros(len(x), dtype=np.int32), [(self.root, np.arange(len(x)))]
        passed = []
        while todo:
            node, at = todo.pop()
            if isinstance(node, Node):
                d = squared(x[at], node.points)
                to = d.argmin(axis=1)
                passed.append((node, at, d, to))
                todo += [(child, at[to == j]) for j, child in enumerate(node.children) if (to == j).any()]
            else:
                leaf[at] = node
        return passed, leaf

    def ranges(self, rows) -> None:
        """Take (node, point, child, low, high, norm_low, norm_high) of all vectors; a child without any stays empty and is never visited."""
        for node in self.nodes:
            m = len(node.points)
            node.low, node.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
            node.norm_low, node.norm_high = np.full(m, np.inf), np.full(m, -np.inf)
        for n, i, j, low, high, norm_low, norm_high in rows:
            node = self.nodes[n]
            node.low[i, j], node.high[i, j] = np.sqrt(low), np.sqrt(high)
            node.norm_low[j], node.norm_high[j] = norm_low, norm_high

    def visited(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Row x leaf: leaves that can hold a vector whose inner product with the row lies in one of its windows.

        ``low`` and ``high`` have one column a window; a window with ``low > high`` asks for nothing.
        """
        out = np.zeros((len(x), self.leaves), dtype=bool)
        norm = (x * x).sum(axis=1).astype(np.float64)
        todo = [(self.root, np.nonzero(np.ones(low.shape, dtype=bool)))]
        while todo:
            node, (row, w) = todo.pop()
            keep = low[row, w] <= high[row, w]
            row, w = row[keep], w[keep]
            if not len(row):
                continue
            if not isinstance(node, Node):
                out[row, node] = True
                continue
            rows, back = np.unique(row, return_inverse=True)
            d = np.sqrt(squared(x[rows], node.points).astype(np.float64))[back]
            for j, child in enumerate(node.children):
                if node.norm_high[j] < 0:
                    continue
                far = norm[row] + node.norm_high[j] - 2.0 * low[row, w]
                near = np.sqrt(np.maximum(0.0, norm[row] + node.norm_low[j] - 2.0 * high[row, w]))
                slack = MARGIN * (norm[row] + node.norm_high[j] + 1.0)
                alive = far >= -slack
                outer = np.sqrt(np.maximum(0.0, far) + slack)
                edge = MARGIN * (d + outer[:, None] + near[:, None] + 1.0)
                least = np.maximum(np.maximum(d - outer[:, None], near[:, None] - d), 0.0) - edge
                alive &= ((least <= node.high[:, j]) & (d + outer[:, None] + edge >= node.low[:, j])).all(axis=1)
                if alive.any():
                    todo.append((child, (row[alive], w[alive])))
        return out
