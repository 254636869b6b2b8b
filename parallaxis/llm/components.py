"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.llm import _work


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component of every node of the links, with component the smallest node reachable.

    Links are undirected; loops, repeats and links with a null end count for
    nothing. A round moves each edge towards the smallest neighbour, with
    minima pre-aggregated before they are joined back, so a node of very many
    links is no single task's work. Rounds grow with the logarithm of the
    longest path. No links give an empty table.
    """
    edges = links.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).filter("a <> b").distinct()
    edges = _work.cut(edges)
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = _work.cut(small)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Forest:
    """Union-find over 0..n-1 that keeps only the links that join two trees; for use inside a task."""

    def __init__(self, n: int):
        import numpy as np

        self.np, self.label, self.links = np, np.arange(n), []

    def _root(self, parent: list[int], x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def add(self, i, j) -> None:
        np = self.np
        new = self.label[i] != self.label[j]
        if not new.any():
            return
        pairs = np.unique(np.stack([self.label[i[new]], self.label[j[new]]]), axis=1, return_index=True)
        at = np.flatnonzero(new)[pairs[1]]
        nodes, ends = np.unique(pairs[0], return_inverse=True)
        ends = ends.reshape(2, -1)
        parent = list(range(len(nodes)))
        for x, y, k in zip(ends[0].tolist(), ends[1].tolist(), at.tolist()):
            a, b = self._root(parent, x), self._root(parent, y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                self.links.append((int(i[k]), int(j[k])))
        roots = nodes[[self._root(parent, x) for x in range(len(nodes))]]
        moved = np.arange(len(self.label))
        moved[nodes] = roots
        self.label = moved[self.label]

    def stars(self, node):
        """src, dst: each node (a number for each of 0..n-1) of a tree of several with the smallest of its tree. Tasks that find the same crowd give the same rows, where their spanning links would all differ."""
        np = self.np
        low = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(low, self.label, node)
        centre = low[self.label]
        out = node != centre
        return node[out], centre[out]
