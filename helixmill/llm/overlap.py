"""Windows that stand in the training split and in an evaluation split (problem 7), the same or nearly, on either strand.

A plain 64-bit similarity hash can't be cut into blocks here: at a similarity of 0.6 two such hashes differ in 15 of 64 bits
(standard deviation 3.4), so a radius of 25 and blocks of two bits were needed. The fingerprint therefore has two parts: the
blocks, which are the seeds of the sketches (on the evaluation side those of either strand) and are joined across splits, and the bits, a code of 1,024 whose Hamming distance within the radius is necessary for the similarity. The
sets themselves are compared last.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.labels import first_delivery
from helixmill.functions.windows import windows
from helixmill.llm.neardup import expand
from helixmill.llm.sketch import Shard, distance, enough, radius, similar_representatives

THRESHOLD = 0.6


def split_of(column: Column | str) -> Column:
    """train, validation or test from any spelling, null where none is given."""
    s = F.lower(F.trim(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"^\s+|\s+$", "")))
    return F.when(s.isin("train", "training", "trn"), "train").when(s.isin("validation", "valid", "val", "dev", "validate"), "validation").when(s.isin("test", "testing", "tst"), "test")


def _across(t: float):
    def compare(s: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = s.sizes()
        code, turned = s.code[s.at], s.complement_code()[s.at]
        start = np.flatnonzero(np.r_[True, s.shard[1:] != s.shard[:-1]]) if len(s.shard) else np.zeros(0, np.int64)
        count = np.diff(np.r_[start, len(s.shard)])
        mine = np.bincount(s.shard, weights=s.own, minlength=len(start)).astype(np.int64)  # members come first
        found = [np.zeros((3, 0), np.int64)]
        load = np.cumsum(count[s.shard]) // 200_000
        for part in np.unique(load):
            q = np.flatnonzero(load == part)
            n = mine[s.shard[q]]
            i = np.repeat(q, n)
            j = np.arange(n.sum()) + np.repeat(start[s.shard[q]] - (np.cumsum(n) - n), n)
            ok = (s.ids[i] != s.ids[j]) & (~s.own[i] | (s.ids[i] > s.ids[j])) & ((s.left[i] & s.right[j]) | (s.right[i] & s.left[j]))
            i, j = i[ok], j[ok]
            r = radius(size[i], size[j], t)
            for k, other in enumerate((code, turned)):
                near = distance(code[i], other[j]) <= r
                found.append(np.stack([i[near], j[near], np.full(near.sum(), k)]))
        i, j, k = np.concatenate(found, axis=1)
        low, high = np.minimum(s.at[i], s.at[j]), np.maximum(s.at[i], s.at[j])
        _, once = np.unique((low * len(s.n8) + high) * 2 + k, return_index=True)
        i, j, k = i[once], j[once], k[once]
        c = np.zeros(len(i), np.int64)
        for way in (0, 1):
            c[k == way] = s.common(i[k == way], j[k == way], bool(way))
        ok = enough(c, size[i], size[j], t)
        return i[ok], j[ok], c[ok] / (size[i] + size[j] - c)[ok]

    return compare


def split_windows(records: DataFrame) -> DataFrame:
    """(row_index, window, side): the windows of records with a split; side is left for train, right for validation and test."""
    side = first_delivery(records, "row_index", ["split_name"]).select("row_index", F.when(split_of("split_name") == "train", "left").when(split_of("split_name").isNotNull(), "right").alias("side")).where("side is not null")
    return windows(records).join(side, "row_index")


def cross_split_links(records: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs (a, b, similarity) of class representatives across the splits, a class with itself included if both
    sides have records of it; members (row_index, rep, side). Records without a split or a readable 8-mer are in neither."""
    links, members = similar_representatives(split_windows(records), _across(threshold), side="side")
    both = members.groupBy("rep").agg(F.count_distinct("side").alias("n")).where("n = 2").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"))
    return links.unionByName(both), members


def cross_split_pairs(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row_index_a, row_index_b), a < b: all pairs of records of at least the threshold, one in train, the other not."""
    links, members = cross_split_links(records, threshold)
    both = expand(links.select("a", "b"), members, "side").where("x_e <> y_e")
    return both.select(F.least("x", "y").alias("row_index_a"), F.greatest("x", "y").alias("row_index_b")).distinct()


def overlap_report(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(split_name, source, n_records, n_overlapping): of each evaluation split and source, how many records also stand in train.

    Sources are compared without case and surrounding blanks; a missing source is null. Linked classes are enough here, so copies aren't paired.
    """
    links, members = cross_split_links(records, threshold)
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other"))).distinct()
    trained = members.where("side = 'left'").select(F.col("rep").alias("other")).distinct()
    hit = ends.join(trained, "other").select("rep").distinct().withColumn("hit", F.lit(1))
    flagged = members.where("side = 'right'").join(hit, "rep", "left").select("row_index", "hit")
    about = first_delivery(records, "row_index", ["split_name", "source"]).select("row_index", split_of("split_name").alias("split_name"), F.nullif(F.lower(F.trim("source")), F.lit("")).alias("source")).where("split_name in ('validation', 'test')")
    return about.join(flagged, "row_index", "left").groupBy("split_name", "source").agg(F.count("*").alias("n_records"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_overlapping"))
