"""Co-dependence of labels: co-occurrence, P(i given j), partners, asymmetry, profile similarity and clusters.

The matrices have as many cells as pairs of labels (122 * 122 here); they are long tables (i, j, value).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Clustering solves on the driver for at most so many labels.
MOST_LABELS = 2000


def cooccurrence(p: DataFrame, row: str = "sample_id", item: str = "protein_id", value: str = "score") -> DataFrame:
    """(i, j, c): the sum over rows of value_i * value_j. Rows hold a bounded number of labels, so the self-join stays within them."""
    a = p.select(row, F.col(item).alias("i"), F.col(value).alias("a"))
    b = p.select(row, F.col(item).alias("j"), F.col(value).alias("b"))
    return a.join(b, row).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("c"))


def conditional(c: DataFrame, labels: DataFrame) -> DataFrame:
    """(i, j, p) for all pairs of labels (protein_id): c(i, j) / c(j, j), 0 where the diagonal is."""
    diag = c.where("i = j").select(F.col("j"), F.col("c").alias("d"))
    grid = labels.select(F.col("protein_id").alias("i")).crossJoin(F.broadcast(labels.select(F.col("protein_id").alias("j"))))  # cells of the matrix
    x = grid.join(c, ["i", "j"], "left").join(F.broadcast(diag), "j", "left")
    return x.select("i", "j", F.when(F.coalesce("d", F.lit(0.0)) > 0, F.coalesce("c", F.lit(0.0)) / F.col("d")).otherwise(0.0).alias("p"))


def top_partners(c: DataFrame, k: int, least_diagonal: float = 0.0) -> DataFrame:
    """(anchor, rank, partner, value): the k largest c(i, anchor) of each anchor with a diagonal of at least so much."""
    anchors = c.where((F.col("i") == F.col("j")) & (F.col("c") >= least_diagonal)).select("j")
    w = Window.partitionBy("j").orderBy(F.desc("c"), "i")
    x = c.where("i <> j").join(F.broadcast(anchors), "j").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return x.select(F.col("j").alias("anchor"), "rank", F.col("i").alias("partner"), F.col("c").alias("value"))


def asymmetric_pairs(p: DataFrame, n: int | None = None) -> DataFrame:
    """(i, j, p_ij, p_ji, difference, magnitude), i < j, largest magnitude first."""
    b = p.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("p").alias("p_ji"))
    x = p.where("i < j").join(b, ["i", "j"]).select("i", "j", F.col("p").alias("p_ij"), "p_ji")
    x = x.withColumn("difference", F.col("p_ij") - F.col("p_ji")).withColumn("magnitude", F.abs("difference"))
    return x if n is None else x.orderBy(F.desc("magnitude"), "i", "j").limit(n)


def profile_cosine(p: DataFrame) -> DataFrame:
    """(i, j, cosine) of the labels' columns of a long matrix (i, j, p), i < j; null for an all-zero column."""
    a = p.select(F.col("i").alias("r"), F.col("j").alias("i"), F.col("p").alias("a"))
    b = p.select(F.col("i").alias("r"), F.col("j").alias("j"), F.col("p").alias("b"))
    dot = a.where("a <> 0").join(b.where("b <> 0"), "r").where("i < j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    n = p.groupBy(F.col("j").alias("i")).agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("n"))
    return dot.join(F.broadcast(n), "i").join(F.broadcast(n.select(F.col("i").alias("j"), F.col("n").alias("m"))), "j").select("i", "j", (F.col("dot") / (F.col("n") * F.col("m"))).alias("cosine"))


def top_mass(c: DataFrame, k: int) -> DataFrame:
    """(protein_id, mass): the k labels of the largest row sums, in the order of their ids."""
    m = c.groupBy("i").agg(F.sum("c").alias("mass")).orderBy(F.desc("mass"), "i").limit(k)
    return m.select(F.col("i").alias("protein_id"), "mass").orderBy("protein_id")


def average_linkage(d: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers of rows from a distance matrix: the closest two clusters merge while their mean distance is within the cut."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, member = np.ones(n), [[i] for i in range(n)]
    live = list(range(n))
    while len(live) > 1:
        sub = d[np.ix_(live, live)]
        a, b = divmod(int(np.argmin(sub)), len(live))
        if sub[a, b] > cut:
            break
        i, j = live[min(a, b)], live[max(a, b)]
        merged = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        size[i] += size[j]
        member[i] += member[j]
        live.remove(j)
    out = np.zeros(n, int)
    for k, i in enumerate(sorted(live, key=lambda i: min(member[i]))):
        out[member[i]] = k
    return out


def clusters(p: DataFrame, cut: float = 0.6, shrink: float = 0.8, bright: float = 0.3, depth: int = 4) -> DataFrame:
    """(cluster, protein_id, cohesion, brightness, strength) from a long matrix (i, j, p).

    The matrix is made symmetric; labels cluster by average linkage of cosine distances, and a cluster whose mean cell is not
    bright is cut again with a smaller distance, at most `depth` times. Groups of one label are left out. cohesion is 1 less
    the mean distance, brightness the mean cell, strength the mean of both.
    """
    spark = p.sparkSession
    rows = p.where("p <> 0").limit(MOST_LABELS * MOST_LABELS + 1).collect()
    ids = sorted({r.i for r in rows} | {r.j for r in rows})
    if len(ids) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} labels")
    at = {x: k for k, x in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for r in rows:
        m[at[r.i], at[r.j]] = r.p
    m = (m + m.T) / 2
    norm = np.sqrt((m * m).sum(1))
    cos = m @ m.T / np.maximum(np.outer(norm, norm), 1e-12)
    dist = np.clip(1 - cos, 0, None)
    found: list[list[int]] = []

    def split(own: list[int], limit: float, left: int) -> None:
        labels = average_linkage(dist[np.ix_(own, own)], limit)
        for k in range(labels.max(initial=-1) + 1):
            part = [own[x] for x in np.flatnonzero(labels == k)]
            if len(part) < 2:
                continue
            cells = m[np.ix_(part, part)][~np.eye(len(part), dtype=bool)]
            if cells.mean() >= bright or left == 0 or len(part) == 2:
                found.append(part)
            else:
                split(part, limit * shrink, left - 1)

    if ids:
        split(list(range(len(ids))), cut, depth)
    out = []
    for k, part in enumerate(sorted(found)):
        off = ~np.eye(len(part), dtype=bool)
        cohesion = 1 - float(dist[np.ix_(part, part)][off].mean())
        brightness = float(m[np.ix_(part, part)][off].mean())
        out += [(k, int(ids[x]), cohesion, brightness, (cohesion + brightness) / 2) for x in part]
    return spark.createDataFrame(out, "cluster int, protein_id int, cohesion double, brightness double, strength double")
