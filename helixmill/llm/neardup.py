"""Near-duplicate windows (problem 6): BK-trees over 1,024-bit codes, one tree a shard, exact similarity behind them.

The trees aren't broadcast: they hold codes of all records and so grow with the data. Each comes to life in the task to which
its shard was shuffled, with the shard's windows as its queries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators.components import components
from helixmill.llm.sketch import Shard, distance, enough, radius, similar_representatives
from helixmill.session import broadcast_if_small, materialize

THRESHOLD = 0.6
_WIDE = 2048  # more than any distance of codes


class BKForest:
    """BK-trees of several shards, grown and searched level by level.

    A node's children are keyed by their integer Hamming distance to it; at most one child a distance. code: a row's code;
    tree: the row's tree; member: whether it is a node.
    """

    def __init__(self, code: np.ndarray, tree: np.ndarray, member: np.ndarray):
        self.code, self.tree = code, tree
        nodes = np.flatnonzero(member)
        trees, first = np.unique(tree[nodes], return_index=True)
        self.root = np.full(int(tree.max()) + 1 if len(tree) else 0, -1, np.int64)
        self.root[trees] = nodes[first]
        rest = np.setdiff1d(nodes, self.root[trees])
        at = self.root[tree[rest]]
        keys, kids = [], []
        while len(rest):
            key = at * _WIDE + distance(code[rest], code[at])
            edge, where = np.unique(key, return_index=True)
            keys.append(edge)
            kids.append(rest[where])
            left = np.ones(len(rest), bool)
            left[where] = False
            at = rest[where][np.searchsorted(edge, key[left])]
            rest = rest[left]
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.child = np.concatenate(kids) if kids else np.zeros(0, np.int64)
        order = np.argsort(self.key)
        self.key, self.child = self.key[order], self.child[order]

    def search(self, rows: np.ndarray, reach: np.ndarray, most: int = 200_000):
        """Yields (rows, nodes, distances) within reach[i] of rows[i]; only edges within the reach are followed."""
        size = np.bincount(self.tree, minlength=len(self.root))[self.tree[rows]]
        part = np.cumsum(size) // most
        for p in np.unique(part):
            q = np.flatnonzero(part == p)
            node = self.root[self.tree[rows[q]]]
            q = q[node >= 0]
            node = node[node >= 0]
            while len(q):
                d = distance(self.code[rows[q]], self.code[node])
                hit = d <= reach[q]
                yield rows[q[hit]], node[hit], d[hit]
                lo = np.searchsorted(self.key, node * _WIDE + np.maximum(d - reach[q], 0))
                hi = np.searchsorted(self.key, node * _WIDE + np.minimum(d + reach[q], _WIDE - 1), "right")
                n = hi - lo
                q = np.repeat(q, n)
                node = self.child[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)]


def _search(t: float):
    def compare(s: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = s.sizes()
        forest = BKForest(s.code[s.at], s.shard, s.own)
        most = radius(size, np.floor(size / t).astype(np.int64), t)  # a larger partner is too large
        found = [np.zeros((2, 0), np.int64)]
        for q, node, d in forest.search(np.arange(len(size)), most):
            ok = (d <= radius(size[q], size[node], t)) & (~s.own[q] | (s.ids[q] > s.ids[node])) & (s.ids[q] != s.ids[node])
            found.append(np.stack([q[ok], node[ok]]))
        i, j = np.concatenate(found, axis=1)
        low, high = np.minimum(s.at[i], s.at[j]), np.maximum(s.at[i], s.at[j])
        _, once = np.unique(low * len(s.n8) + high, return_index=True)  # a pair that meets in several shards is compared once
        i, j = i[once], j[once]
        c = s.common(i, j)
        ok = enough(c, size[i], size[j], t)
        return i[ok], j[ok], c[ok] / (size[i] + size[j] - c)[ok]

    return compare


def near_duplicates(windows: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links, members) of windows (row_index, window).

    links (a, b, similarity): all pairs of class representatives, a < b, of at least the threshold. members (row_index, rep):
    every record with a readable 8-mer; records of one rep have equal sets (similarity 1). Records without one are in neither.
    An empty table gives empty results.
    """
    return similar_representatives(windows, _search(threshold))


def pairs(windows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row_index_a, row_index_b): all pairs of records of at least the threshold, a < b, copies written out."""
    links, members = near_duplicates(windows, threshold)
    links = links.select("a", "b")
    twin = members.where("row_index <> rep").select("rep").distinct().select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    return expand(links.unionByName(twin), members).where("x <> y").select(F.least("x", "y").alias("row_index_a"), F.greatest("x", "y").alias("row_index_b")).distinct()


def expand(links: DataFrame, members: DataFrame, extra: str | None = None) -> DataFrame:
    """(x, y, with extra its values x_e and y_e) of the members of linked representatives."""
    more = [extra] if extra else []
    m = members.select("row_index", "rep", *more)
    x = m.select(F.col("row_index").alias("x"), F.col("rep").alias("a"), *[F.col(c).alias("x_e") for c in more])
    y = m.select(F.col("row_index").alias("y"), F.col("rep").alias("b"), *[F.col(c).alias("y_e") for c in more])
    return links.join(x, "a").join(y, "b").drop("a", "b")


def groups(windows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row_index, class_row_index, group_row_index, n_links): each record's class of equal sets, the smallest row_index of its
    group (links chain) and the number of other records that it is directly similar to."""
    links, members = near_duplicates(windows, threshold)
    links = materialize(links.select("a", "b"), "links")
    size = members.groupBy("rep").agg(F.count("*").alias("n"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(size.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    comp = components(links, "a", "b")
    out = members.join(size, "rep").join(degree.withColumnRenamed("a", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("row_index", F.col("rep").alias("class_row_index"), F.coalesce("component", "rep").alias("group_row_index"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("int").alias("n_links"))
