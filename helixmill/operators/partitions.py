"""Leakage-safe partitions: groups of equal or reverse-complement windows and shared transcripts, placed whole.

Groups of similar windows, and a placement that balances classes, are in the near-duplicate and split operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.hashing import hash_rank
from helixmill.functions.sequence import gc_decile, gc_fraction, reverse_complement
from helixmill.operators.components import components
from helixmill.session import broadcast_if_small, materialize

SHARES = (("train", 0.70), ("validation", 0.15), ("test", 0.15))
SEED = 20260925


def duplicate_groups(windows: DataFrame) -> DataFrame:
    """(row_index, group_row_index, n): records whose windows are equal or reverse complements; only groups of two or more. windows (row_index, seq)."""
    w = windows.where("seq <> ''").select("row_index", F.sha2(F.least("seq", reverse_complement("seq")), 256).alias("k"))
    g = w.groupBy("k").agg(F.min("row_index").alias("group_row_index"), F.count("*").alias("n")).where("n > 1")
    return w.join(broadcast_if_small(g), "k").select("row_index", "group_row_index", "n")


def group_components(windows: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(row_index, component): chains of equal windows and of transcripts (row_index, transcript; null ties nothing). component is the smallest row_index."""
    same = duplicate_groups(windows).select(F.col("row_index").alias("a"), F.col("group_row_index").alias("b"))
    t = transcripts.where("transcript is not null")
    first = t.groupBy("transcript").agg(F.min("row_index").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    tied = t.join(broadcast_if_small(first), "transcript").select(F.col("row_index").alias("a"), "b")
    comp = components(same.unionByName(tied))
    return windows.select("row_index").join(comp, F.col("row_index") == F.col("node"), "left").select("row_index", F.coalesce("component", "row_index").alias("component"))


def component_ids(members: DataFrame) -> DataFrame:
    """(component, n, component_id): the id is a hash of the sorted sample ids, in two levels: the ids that share the first two
    digits of their own hash make one hash, and these hashes in order the component's. So no row holds a large component's ids."""
    sid = F.concat(F.lit("row_"), F.col("row_index").cast("string"))
    digest = lambda c, sep: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), sep), 256)
    part = members.select("component", sid.alias("sid")).withColumn("part", F.substring(F.sha2("sid", 256), 1, 2)).groupBy("component", "part").agg(F.count("*").alias("k"), digest(F.col("sid"), ",").alias("d"))
    return part.groupBy("component").agg(F.sum("k").alias("n"), digest(F.concat("part", F.lit(":"), "d"), ",").alias("component_id"))


def component_gate(members: DataFrame) -> DataFrame:
    """(n_records, largest_share, top20_share, passed): fails if one component holds over 5 percent or 20 hold over 20 percent."""
    size = members.groupBy("component").agg(F.count("*").alias("n"))
    top = size.orderBy(F.desc("n"), "component").limit(20).agg(F.coalesce(F.max("n"), F.lit(0)).alias("a"), F.coalesce(F.sum("n"), F.lit(0)).alias("b"))
    x = members.agg(F.count("*").alias("n_records")).join(F.broadcast(top))  # one row each
    a, b = F.col("a") / F.nullif(F.col("n_records"), F.lit(0)), F.col("b") / F.nullif(F.col("n_records"), F.lit(0))
    return x.select("n_records", a.alias("largest_share"), b.alias("top20_share"), ((a <= 0.05) & (b <= 0.20)).alias("passed"))


def assign(members: DataFrame, shares: tuple[tuple[str, float], ...] = SHARES, seed: int = SEED) -> DataFrame:
    """(row_index, component, split_name): components in the order of a hash, cut where the running count of records passes each share.

    The running count has two levels, buckets of hashes and the components of a bucket, so no task sees them all.
    """
    h = hash_rank(seed, F.col("component"))
    size = members.groupBy("component").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("bucket", F.substring("h", 1, 3))
    per = size.groupBy("bucket").agg(F.sum("n").alias("m"))
    w = Window.orderBy("bucket")  # at most 4,096 rows
    starts = per.withColumn("start", F.sum("m").over(w) - F.col("m")).withColumn("total", F.sum("m").over(Window.partitionBy())).select("bucket", "start", "total")
    inside = Window.partitionBy("bucket").orderBy("h", "component")
    x = size.join(F.broadcast(starts), "bucket").withColumn("at", F.col("start") + F.sum("n").over(inside) - F.col("n") / 2)
    name, cut = None, 0.0
    for s, share in shares[:-1]:
        cut += share
        hit = F.col("at") < F.col("total") * cut
        name = F.when(hit, s) if name is None else name.when(hit, s)
    x = x.withColumn("split_name", name.otherwise(shares[-1][0]))
    return members.join(x.select("component", "split_name"), "component").select("row_index", "component", "split_name")


def folds(members: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """(row_index, component, fold): components whole in k folds of about equal size."""
    a = assign(members, tuple((str(i), 1 / k) for i in range(k)), seed)
    return a.select("row_index", "component", F.col("split_name").cast("int").alias("fold"))


def balance(assigned: DataFrame, observations: DataFrame, least: int = 30, shares: tuple[tuple[str, float], ...] = SHARES) -> DataFrame:
    """(split_name, protein_id, y, n, share, off_share, below_minimum): classes by split. off_share: over 3 points from the target; a minimum holds outside train."""
    x = assigned.join(observations, "row_index").groupBy("split_name", "protein_id", "y").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("protein_id", "y"))
    target = F.create_map(*[F.lit(v) for s in shares for v in s])[F.col("split_name")]
    share = F.col("n") / total
    return x.select("split_name", "protein_id", "y", "n", share.alias("share"), (F.abs(share - target) > 0.03).alias("off_share"), ((F.col("split_name") != shares[0][0]) & (F.col("n") < least)).alias("below_minimum"))


def crossing(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, split_a, split_b): edges whose ends lie in different splits; none for a sound assignment."""
    s = assigned.select("row_index", "split_name")
    x = edges.join(s.select(F.col("row_index").alias("a"), F.col("split_name").alias("split_a")), "a").join(s.select(F.col("row_index").alias("b"), F.col("split_name").alias("split_b")), "b")
    return x.where("split_a <> split_b").select("a", "b", "split_a", "split_b")


def matched_negatives(windows: DataFrame, observations: DataFrame, seed: int = SEED) -> DataFrame:
    """(protein_id, gc_decile, positive, negative): positives and negatives of one protein and GC tenth, paired in the order of a hash."""
    x = windows.select("row_index", gc_decile("seq").alias("gc_decile")).join(observations, "row_index")
    sid = F.concat(F.lit(f"{seed}:"), F.col("row_index").cast("string"))
    w = Window.partitionBy("protein_id", "gc_decile", "y").orderBy(F.sha2(sid, 256), "row_index")
    r = x.withColumn("r", F.row_number().over(w))
    a = r.where("y = 1").select("protein_id", "gc_decile", "r", F.col("row_index").alias("positive"))
    b = r.where("y = 0").select("protein_id", "gc_decile", "r", F.col("row_index").alias("negative"))
    return a.join(b, ["protein_id", "gc_decile", "r"]).select("protein_id", "gc_decile", "positive", "negative")


BASELINES = ("random", "gc", "3-mer", "6-mer")


def baseline_features(windows: DataFrame, kind: str) -> DataFrame:
    """(row_index, features) of windows (row_index, seq): a hash (random), the share of G and C (gc), or the shares of all k-mers of
    readable bases (k-mer). Empty windows have zeros."""
    from pyspark.ml.functions import array_to_vector

    if kind == "random":
        u = F.pmod(F.xxhash64(F.lit(SEED), "row_index"), F.lit(1 << 30)) / float(1 << 30)
        return windows.select("row_index", array_to_vector(F.array(u)).alias("features"))
    if kind == "gc":
        return windows.select("row_index", array_to_vector(F.array(gc_fraction("seq").cast("double"))).alias("features"))
    k = int(kind.split("-")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.full(256, 4, np.uint8)
        code[list(b"ACGTacgt")] = [0, 1, 2, 3] * 2
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                out = np.zeros((b.num_rows, 4**k))
                for i, s in enumerate(b.column("seq").to_pylist()):
                    c = code[np.frombuffer((s or "").encode("latin-1", "replace"), np.uint8)]
                    if len(c) < k:
                        continue
                    v, ok = np.zeros(len(c) - k + 1, np.int64), np.ones(len(c) - k + 1, bool)
                    for j in range(k):
                        part = c[j : len(c) - k + 1 + j]
                        v, ok = (v << 2) | (part & 3), ok & (part < 4)
                    if ok.any():
                        out[i] = np.bincount(v[ok], minlength=4**k) / ok.sum()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * 4**k), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("row_index"), lists], names=["row_index", "features"])

    return windows.select("row_index", "seq").mapInArrow(run, "row_index long, features array<double>").select("row_index", array_to_vector("features").alias("features"))


def baseline(windows: DataFrame, observations: DataFrame, assigned: DataFrame, protein_id: int, kind: str = "3-mer", regularization: float = 0.01) -> DataFrame:
    """(row_index, y, score, split_name) of one protein's known records by a logistic regression on baseline_features, fitted on train."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    own = observations.where(F.col("protein_id") == protein_id).select("row_index", F.col("y").cast("double").alias("label"))
    x = baseline_features(windows.join(own.select("row_index"), "row_index", "left_semi"), kind)
    v = materialize(x.join(own, "row_index").join(assigned.select("row_index", "split_name"), "row_index"), "features")
    model = LogisticRegression(maxIter=50, regParam=regularization).fit(v.where("split_name = 'train'"))
    return model.transform(v).select("row_index", F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("score"), "split_name")
