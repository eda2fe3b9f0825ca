"""Deterministic stratified sample: hash-ranked representatives, quotas per protein and class, filler.

Ranks are hashes, so the result depends on no input order. Quotas depend on one another pick by pick, so their loop runs on the
driver, over as many candidates of each protein and class as it and the classes before it may still pick: more can't be looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.hashing import label_blind_rank, quota_rank
from helixmill.session import materialize

REPRESENTATIVE, QUOTA, FILLER = "representative", "quota", "filler"


class QuotaError(ValueError):
    """A quota that the records can't satisfy."""


def _blind(ids: DataFrame, seed: int) -> DataFrame:
    return ids.withColumn("blind", label_blind_rank(seed, F.col("sample_id")))


def representatives(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """(row_index, sample_id, rank) of the n lowest label-blind ranks. ids (row_index, sample_id)."""
    top = _blind(ids, seed).orderBy("blind", "sample_id").limit(n)
    w = Window.orderBy("blind", "sample_id")  # over the n rows of the sample
    return top.withColumn("rank", F.row_number().over(w)).select("row_index", "sample_id", "rank")


def first_sources(ids: DataFrame, n: int) -> DataFrame:
    """(sample_id): the first n ids in the order of their text, in which row_10 comes before row_2; the sources of controls."""
    return ids.where("sample_id is not null").select("sample_id").distinct().orderBy("sample_id").limit(n)


def quota_candidates(observations: DataFrame, chosen: DataFrame, seed: int, n: int) -> DataFrame:
    """(protein_id, y, rank, sample_id): of each protein and class the n records of the lowest quota rank that aren't chosen."""
    o = observations.join(chosen.select("row_index"), "row_index", "left_anti").withColumn("sample_id", F.concat(F.lit("row_"), F.col("row_index").cast("string")))
    name = F.when(F.col("y") == 1, "positive").otherwise("negative")
    o = o.withColumn("h", quota_rank(seed, F.col("sample_id"), F.col("protein_id"), name))
    w = Window.partitionBy("protein_id", "y").orderBy("h", "sample_id")
    return o.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("protein_id", "y", "rank", "sample_id")


def build_sample(ids: DataFrame, observations: DataFrame, total: int, representative: int, min_positive: int, min_negative: int, seed: int, proteins: int = 122, strict: bool = True) -> DataFrame:
    """(row_index, sample_id, stratum). strict: an unsatisfied quota raises QuotaError; else it is filled as far as it goes.

    Raises QuotaError too if strata exceed `total` or too few records are there (strict), else returns what there is.
    """
    spark = ids.sparkSession
    rep = materialize(representatives(ids, representative, seed), "representatives")
    counts = {(r.protein_id, r.y): r.n for r in observations.join(rep.select("row_index"), "row_index").groupBy("protein_id", "y").agg(F.count("*").alias("n")).collect()}
    # a class looks past as many of its candidates as the classes before it may have picked
    limits, picks = [], 0
    for protein in range(1, proteins + 1):
        for y, least in ((1, min_positive), (0, min_negative)):
            if (want := least - counts.get((protein, y), 0)) > 0:
                picks += want
                limits.append((protein, y, picks))
    most = F.broadcast(spark.createDataFrame(limits, "protein_id int, y int, most int"))
    cand = materialize(quota_candidates(observations, rep, seed, picks).join(most, ["protein_id", "y"]).where(F.col("rank") <= F.col("most")), "candidates")
    labels = cand.select("sample_id").distinct().join(observations.withColumn("sample_id", F.concat(F.lit("row_"), F.col("row_index").cast("string"))), "sample_id")
    by: dict[tuple[int, int], list[str]] = {}
    for r in sorted(cand.collect(), key=lambda r: r["rank"]):
        by.setdefault((r.protein_id, r.y), []).append(r.sample_id)
    of: dict[str, list[tuple[int, int]]] = {}
    for r in labels.collect():
        of.setdefault(r.sample_id, []).append((r.protein_id, r.y))
    taken: list[str] = []
    seen: set[str] = set()
    for protein in range(1, proteins + 1):
        for y, least in ((1, min_positive), (0, min_negative)):
            want = least - counts.get((protein, y), 0)
            picks = [s for s in by.get((protein, y), []) if s not in seen][: max(0, want)]
            if strict and len(picks) < want:
                raise QuotaError(f"protein {protein}, class {y}: {want} more needed, {len(picks)} there")
            for s in picks:
                seen.add(s)
                taken.append(s)
                for key in of[s]:
                    counts[key] = counts.get(key, 0) + 1
    if strict and representative + len(taken) > total:
        raise QuotaError(f"{representative} representatives and {len(taken)} of quotas exceed {total}")
    quota = spark.createDataFrame([(s,) for s in taken], "sample_id string")
    first = rep.select("row_index", "sample_id").withColumn("stratum", F.lit(REPRESENTATIVE))
    second = ids.join(F.broadcast(quota), "sample_id").select("row_index", "sample_id").withColumn("stratum", F.lit(QUOTA))
    done = first.unionByName(second)
    pool = _blind(ids.join(done.select("sample_id"), "sample_id", "left_anti"), seed)
    rest = pool.orderBy("blind", "sample_id").limit(max(0, total - representative - len(taken))).select("row_index", "sample_id").withColumn("stratum", F.lit(FILLER))
    out = done.unionByName(rest)
    if strict and out.count() < total:
        raise QuotaError(f"fewer than {total} records")
    return out
