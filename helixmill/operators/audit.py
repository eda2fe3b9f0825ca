"""Audit of labelled windows: three-state observations, counts, composition and tie-aware areas under the ROC curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.labels import first_delivery, label_values
from helixmill.functions.sequence import center, gc_fraction
from helixmill.functions.stats import auc_from_ranks, orientation_adjusted

PROTEINS = 122


def label_problems(records: DataFrame, names: dict[str, int], proteins: int = PROTEINS) -> DataFrame:
    """(row_index, out_of_range, zero, repeated, contradicting): records whose values a strict reading refuses."""
    v = label_values(records, names).where("label_value is not null")
    a = F.abs("label_value")
    per = v.groupBy("row_index").agg(
        F.max(a > proteins).alias("out_of_range"), F.max(a == 0).alias("zero"), (F.count("*") > F.count_distinct("label_value")).alias("repeated"), (F.count_distinct("label_value") > F.count_distinct(a)).alias("contradicting")
    )
    return per.where("out_of_range or zero or repeated or contradicting")


def label_observations(records: DataFrame, names: dict[str, int], proteins: int = PROTEINS) -> DataFrame:
    """(row_index, protein_id, y): y 1 or 0. Unknown is no row; ids out of range and ids of both signs in one record count as unknown."""
    v = label_values(records, names).where(F.abs("label_value").between(1, proteins))
    s = F.sign("label_value")
    return v.groupBy("row_index", F.abs("label_value").alias("protein_id")).agg(F.min(s).alias("lo"), F.max(s).alias("hi")).where("lo = hi").select("row_index", "protein_id", (F.col("hi") > 0).cast("int").alias("y"))


def audit_summary(records: DataFrame, observations: DataFrame) -> DataFrame:
    """One row: records, known, positive and negative labels, records of two positives or more, mean known labels a record."""
    n = first_delivery(records, "row_index", [], None).agg(F.count("*").alias("n_records"))
    per = observations.groupBy("row_index").agg(F.count("*").alias("k"), F.sum("y").alias("p"))
    o = per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("known"), F.coalesce(F.sum("p"), F.lit(0)).alias("positive"), F.count(F.when(F.col("p") >= 2, 1)).alias("multi_positive"))
    x = n.join(F.broadcast(o))  # one row each
    return x.select("n_records", "known", "positive", (F.col("known") - F.col("positive")).alias("negative"), "multi_positive", F.when(F.col("n_records") > 0, F.col("known") / F.col("n_records")).alias("mean_known"))


def class_counts(observations: DataFrame, proteins: int = PROTEINS) -> DataFrame:
    """(protein_id, positive, negative, known) of all proteins 1 to `proteins`, zeros included."""
    spark = observations.sparkSession
    per = observations.groupBy("protein_id").agg(F.sum("y").alias("positive"), F.sum(1 - F.col("y")).alias("negative"), F.count("*").alias("known"))
    grid = spark.range(1, proteins + 1).select(F.col("id").cast("int").alias("protein_id"))
    return grid.join(per, "protein_id", "left").fillna(0, ["positive", "negative", "known"])


def rank_auc(df: DataFrame, keys: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """(*keys, positives, negatives, auc), average ranks on ties, null with one class only.

    Equal scores are counted before the window, so the window sorts distinct scores and not rows. keys must be enough to
    spread the work; a single key's distinct scores are sorted in one task.
    """
    g = df.groupBy(*keys, score).agg(F.sum(y).alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(score)
    before = F.sum("n").over(w) - F.col("n")
    g = g.withColumn("rank", before + (F.col("n") + 1) / 2)
    out = g.groupBy(*keys).agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"))
    return out.select(*keys, "positives", "negatives", auc_from_ranks(F.col("r"), F.col("positives"), F.col("negatives")).alias("auc"))


def gc_observations(windows: DataFrame, observations: DataFrame, length: int | None = None) -> DataFrame:
    """(protein_id, y, gc): GC of the window, or of its middle, for each observation. windows (row_index, seq)."""
    s = F.col("seq") if length is None else center("seq", length)
    return windows.select("row_index", gc_fraction(s).alias("gc")).join(observations, "row_index").select("protein_id", "y", "gc")


def gc_auc(windows: DataFrame, observations: DataFrame, length: int | None = None) -> DataFrame:
    """(protein_id, positives, negatives, auc, adjusted)."""
    a = rank_auc(gc_observations(windows, observations, length), ["protein_id"], "gc")
    return a.withColumn("adjusted", orientation_adjusted(F.col("auc")))


def macro_auc(per_protein: DataFrame) -> DataFrame:
    """Means over the proteins with a defined area."""
    return per_protein.agg(F.count("auc").alias("n_defined"), F.avg("auc").alias("macro_direct"), F.avg("adjusted").alias("macro_adjusted"))


def mean_gc_by_class(windows: DataFrame, observations: DataFrame, length: int | None = None) -> DataFrame:
    return gc_observations(windows, observations, length).groupBy("y").agg(F.count("*").alias("n"), F.avg("gc").alias("mean_gc"))
