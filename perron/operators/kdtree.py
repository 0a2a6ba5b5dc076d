"""Nearest points on the sphere by a k-d tree of unit vectors, in batches of numpy arrays."""

from __future__ import annotations

import numpy as np

LEAF = 16
#: Queries that descend together, and pairs of query and node beyond which they are halved.
QUERIES, PAIRS = 8_192, 2_000_000
#: What distances of unit vectors and those of a formula over degrees may differ by.
RELATIVE, ABSOLUTE = 1e-9, 1e-12


def unit(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of finite degrees, and the error allowed them, which grows with degrees far outside their range."""
    a, b = np.radians(np.fmod(lat, 360.0)), np.radians(np.fmod(lon, 360.0))
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1), ABSOLUTE + 1e-16 * (np.abs(lat) + np.abs(lon))


class Tree:
    """Balanced: 2 ** k nodes on level k, halved by their widest axis."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray):
        points, error = unit(lat, lon)
        n = len(points)
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
        order, starts = np.arange(n), np.zeros(1, int)
        self.low, self.high, self.error = [], [], []
        for level in range(self.depth + 1):
            sizes = np.diff(np.append(starts, n))
            low, high = (f.reduceat(points[order], starts, axis=0) for f in (np.minimum, np.maximum))
            self.low.append(low), self.high.append(high), self.error.append(np.maximum.reduceat(error[order], starts))
            if level < self.depth:
                node = np.repeat(np.arange(len(starts)), sizes)
                order = order[np.lexsort((points[order, np.argmax(high - low, axis=1)[node]], node))]
                starts = np.stack([starts, starts + sizes // 2], axis=1).ravel()
        self.points, self.errors, self.order, self.starts, self.sizes = points[order], error[order], order, starts, sizes

    def _away(self, q: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
        """From points to the boxes of nodes."""
        gap = np.maximum(np.maximum(self.low[level][node] - q, q - self.high[level][node]), 0.0)
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _within(self, query: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query with each point of its leaf."""
        sizes = self.sizes[leaf]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(query, sizes), np.repeat(self.starts[leaf], sizes) + inside

    def _descend(self, q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node = np.zeros(len(q), int)
        for level in range(1, self.depth + 1):
            left, right = self._away(q, level, 2 * node), self._away(q, level, 2 * node + 1)
            node = 2 * node + (right < left)
        each = np.arange(len(q))
        reach = np.full(len(q), np.inf)

        def measured(query, leaf):
            query, point = self._within(query, leaf)
            gap = q[query] - self.points[point]
            away, slack = np.sqrt(np.einsum("ij,ij->i", gap, gap)), e[query] + self.errors[point]
            np.minimum.at(reach, query, away * (1 + RELATIVE) + slack)
            return query, point, away * (1 - RELATIVE) - slack

        measured(each, node)
        query, node = each, np.zeros(len(q), int)
        for level in range(1, self.depth + 1):
            query, node = np.repeat(query, 2), (2 * node[:, None] + np.arange(2)).ravel()
            near = self._away(q[query], level, node) * (1 - RELATIVE) - e[query] - self.error[level][node] <= reach[query]
            query, node = query[near], node[near]
            if len(query) > PAIRS and len(q) > 1:
                half = len(q) // 2
                a, b = self._descend(q[:half], e[:half]), self._descend(q[half:], e[half:])
                return np.concatenate([a[0], b[0] + half]), np.concatenate([a[1], b[1]])
        query, point, least = measured(query, node)
        near = least <= reach[query]
        return query[near], self.order[point[near]]

    def nearest(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of queries with those of their nearest points: all that may be nearest within the error allowed."""
        q, e = unit(lat, lon)
        found = [(np.zeros(0, int), np.zeros(0, int))]
        for k in range(0, len(q) if len(self.points) else 0, QUERIES):
            query, point = self._descend(q[k : k + QUERIES], e[k : k + QUERIES])
            found.append((query + k, point))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
