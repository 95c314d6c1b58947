"""Many BK-trees at once: one per shard, built and searched level by level on arrays.

In a BK-tree over Hamming distance a node's children hang on edges named by their integer distance to it, at most one
child an edge; everything at that distance lies below that child. By the triangle inequality all codes within radius r
of a query at distance d from a node lie at it or below the edges d - r to d + r, so a search follows only those.
"""

from __future__ import annotations

import numpy as np


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of codes, one row of 64-bit words each."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class BKForest:
    """Trees over codes of one or more 64-bit words, the first code of each shard its root. Equal codes chain on edge 0. visited counts the nodes that searches looked at."""

    def __init__(self, shard: np.ndarray, code: np.ndarray):
        """shard: whole numbers, in non-decreasing order."""
        n = len(code)
        self.code, self.visited = code, 0
        self.edges = 64 * code.shape[1] + 1
        self.parent = np.full(n, -1, np.int64)
        self.edge = np.full(n, -1, np.int64)
        first = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        self.shards, self.roots = shard[first], np.flatnonzero(first)
        node = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rest = np.flatnonzero(~first)
        at = node[rest]
        while len(rest):
            d = hamming(code[rest], code[at])
            key = at * self.edges + d
            _, firsts, inverse = np.unique(key, return_index=True, return_inverse=True)
            child = rest[firsts]  # the first of those that want the same edge becomes the child, the others go below it
            self.parent[child], self.edge[child] = at[firsts], d[firsts]
            below = child[inverse]
            keep = below != rest
            rest, at = rest[keep], below[keep]
        # children by parent and edge, so that the edges d - r to d + r are one slice
        kids = np.flatnonzero(self.parent >= 0)
        key = self.parent[kids] * self.edges + self.edge[kids]
        order = np.argsort(key, kind="stable")
        self.kids, self.kid_keys = kids[order], key[order]

    def search(self, shard: np.ndarray, code: np.ndarray, radius: int | np.ndarray, most: int = 1 << 21):
        """Yields (query index, node index) arrays of all pairs of one shard within the radius, one for all or one a query."""
        radius = np.broadcast_to(radius, len(code))
        where = np.searchsorted(self.shards, shard)
        ok = (where < len(self.shards)) & (self.shards[np.minimum(where, len(self.shards) - 1)] == shard) if len(self.shards) else np.zeros(len(shard), bool)
        frontier = [(np.flatnonzero(ok), self.roots[where[ok]])]
        while frontier:
            q, node = frontier.pop()
            if len(q) > most:  # bounded memory: the rest waits on the stack
                frontier.append((q[most:], node[most:]))
                q, node = q[:most], node[:most]
            self.visited += len(q)
            d = hamming(code[q], self.code[node])
            r = radius[q]
            near = d <= r
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.kid_keys, node * self.edges + np.maximum(d - r, 0), side="left")
            high = np.searchsorted(self.kid_keys, node * self.edges + np.minimum(d + r, self.edges - 1), side="right")
            n = high - low
            total = int(n.sum())
            if total:
                shift = np.repeat(low - (np.cumsum(n) - n), n)
                frontier.append((np.repeat(q, n), self.kids[np.arange(total) + shift]))
