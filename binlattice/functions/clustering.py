"""Clustering-feature trees: clusters as (n, sum, sum of squares), kept in a height-balanced tree.

Features can be merged, so trees of parts of the points can be, too: the leaves
of one are inserted into another like heavy points.
"""

from __future__ import annotations

import numpy as np


class Node:
    """Up to branching features, with the nodes below them or, in a leaf, the numbers of their clusters."""

    def __init__(self, branching: int, dims: int, leaf: bool):
        self.leaf, self.used, self.below = leaf, 0, []
        self.n, self.total, self.square = np.zeros(branching + 1), np.zeros((branching + 1, dims)), np.zeros(branching + 1)

    def nearest(self, centre: np.ndarray) -> int:
        away = self.total[: self.used] / self.n[: self.used, None] - centre
        return int(np.einsum("ij,ij->i", away, away).argmin())

    def put(self, n: float, total: np.ndarray, square: float, below) -> None:
        self.n[self.used], self.total[self.used], self.square[self.used] = n, total, square
        self.below.append(below)
        self.used += 1

    def add(self, k: int, n: float, total: np.ndarray, square: float) -> None:
        self.n[k] += n
        self.total[k] += total
        self.square[k] += square

    def feature(self) -> tuple[float, np.ndarray, float]:
        return self.n[: self.used].sum(), self.total[: self.used].sum(axis=0), self.square[: self.used].sum()


def spread(n: float, total: np.ndarray, square: float) -> float:
    """Squared radius of a feature: the mean squared distance from its centre."""
    centre = total / n
    return max(0.0, square / n - float(centre @ centre))


class FeatureTree:
    """Inserts features one by one: each joins the nearest cluster on its way down if that stays within the radius, or starts one; full nodes split.

    The order of insertion matters, as the way down and the splits depend on what came
    before. Coordinates are taken from the first one, which keeps squares small.
    """

    def __init__(self, radius: float, branching: int = 50, dims: int = 2):
        if branching < 2:
            raise ValueError("a node needs room for two features")
        self.radius, self.branching, self.dims = radius, branching, dims
        self.root, self.origin, self.count = Node(branching, dims, True), None, 0

    def insert(self, n: float, total: np.ndarray, square: float) -> int:
        """The number of the cluster that the feature joins."""
        if self.origin is None:
            self.origin = np.rint(total / n)
        square = square - 2 * float(self.origin @ total) + n * float(self.origin @ self.origin)
        total = total - n * self.origin
        cluster, split = self._down(self.root, n, total, square)
        if split:
            root = Node(self.branching, self.dims, False)
            for node in split:
                root.put(*node.feature(), node)
            self.root = root
        return cluster

    def _down(self, node: Node, n: float, total: np.ndarray, square: float):
        if node.used:
            k = node.nearest(total / n)
            if not node.leaf:
                cluster, split = self._down(node.below[k], n, total, square)
                if not split:
                    node.add(k, n, total, square)
                    return cluster, None
                first, second = split
                node.below[k] = first
                node.n[k], node.total[k], node.square[k] = first.feature()
                node.put(*second.feature(), second)
                return cluster, self._split(node) if node.used > self.branching else None
            if spread(node.n[k] + n, node.total[k] + total, node.square[k] + square) <= self.radius**2:
                node.add(k, n, total, square)
                return node.below[k], None
        node.put(n, total, square, self.count)
        self.count += 1
        return self.count - 1, self._split(node) if node.used > self.branching else None

    def _split(self, node: Node) -> tuple[Node, Node]:
        """Two nodes around the two features farthest from each other."""
        centre = node.total[: node.used] / node.n[: node.used, None]
        away = ((centre[:, None] - centre[None]) ** 2).sum(axis=2)
        a, b = np.unravel_index(int(away.argmax()), away.shape)
        left, right = Node(self.branching, self.dims, node.leaf), Node(self.branching, self.dims, node.leaf)
        for k in range(node.used):
            own = left if k == a or (k != b and away[k, a] < away[k, b]) else right
            own.put(node.n[k], node.total[k], node.square[k], node.below[k])
        return left, right

    def clusters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, total, square) of the clusters by number."""
        n, total, square = np.zeros(self.count), np.zeros((self.count, self.dims)), np.zeros(self.count)
        rest = [self.root]
        while rest:
            node = rest.pop()
            if not node.leaf:
                rest += node.below
                continue
            for k in range(node.used):
                c = node.below[k]
                n[c], total[c], square[c] = node.n[k], node.total[k], node.square[k]
        if self.origin is not None:
            square = square + 2 * total @ self.origin + n * float(self.origin @ self.origin)
            total = total + n[:, None] * self.origin
        return n, total, square


def inserted(n: np.ndarray, total: np.ndarray, square: np.ndarray, radius: float, branching: int = 50) -> tuple[np.ndarray, FeatureTree]:
    """The cluster of each feature, inserted in order, and the tree."""
    tree = FeatureTree(radius, branching, total.shape[1])
    return np.array([tree.insert(*f) for f in zip(n, total, square, strict=True)], dtype=np.int64), tree
