"""Multi-label evaluation of predictions against known labels, all per-label metrics from counts at distinct scores.

`scored` frames have (sample_id, protein_id, score, y): y is 1 or 0 for known labels; unknown pairs have no row. Metrics first count
positives and rows at each distinct score, so windows run over distinct scores only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.stats import auc_from_ranks, binary_cross_entropy
from helixmill.operators.audit import rank_auc

GRID = tuple(i / 10 for i in range(1, 10))


def latest_predictions(p: DataFrame) -> DataFrame:
    """(sample_id, protein_id, score): the mean over seeds, folds and configurations of each pair's valid scores.

    Rows delivered twice count once, of several rows of one contract key the last scored; null scores and scores outside
    [0, 1] are left out.
    """
    ok = p.where(F.col("score").between(0, 1))
    key = ["sample_id", "protein_id", "fold", "seed", "window_nt", "config_id", "config_hash"]
    once = ok.groupBy(*key).agg(F.max(F.struct("scored_at", "score")).alias("m")).select(*key, F.col("m.score").alias("score"))
    return once.groupBy("sample_id", "protein_id").agg(F.round(F.avg("score"), 6).alias("score"))


def contract_problems(p: DataFrame) -> DataFrame:
    """(problem, n): rows that break the prediction contract; a row may have several problems."""
    flags = F.filter(
        F.array(
            F.when(F.col("score").isNull(), "null_score"),
            F.when(~F.col("score").between(0, 1), "score_out_of_range"),
            F.when(F.col("fold").isNull(), "null_fold"),
            F.when(F.col("sample_id").isNull() | F.col("protein_id").isNull(), "null_key"),
        ),
        lambda x: x.isNotNull(),
    )
    return p.select(F.explode(flags).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def counts_by_score(s: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, score, p, n, tp, fp, all_p, all_n): counts at the score and from the highest score down to it."""
    g = s.groupBy(*keys, "score").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    down = w.orderBy(F.desc("score"))
    tp = F.sum("p").over(down)
    return g.select(*keys, "score", "p", "n", tp.alias("tp"), (F.sum("n").over(down) - tp).alias("fp"), F.sum("p").over(w).alias("all_p"), F.sum(F.col("n") - F.col("p")).over(w).alias("all_n"))


def auroc(s: DataFrame, keys: list[str]) -> DataFrame:
    return rank_auc(s, keys)


def average_precision(s: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, ap): the sum over distinct scores of recall gained times precision; null without positives. Without keys it is micro: then
    one task orders all distinct scores, of which latest_predictions() leaves at most a million, as it rounds to six places."""
    c = counts_by_score(s, keys)
    gained = F.col("p") / F.col("all_p") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.groupBy(*keys).agg(F.sum(F.when(F.col("all_p") > 0, gained)).alias("ap"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    d = 2 * tp + fp + fn
    return F.when(d > 0, 2 * tp / d).otherwise(0.0)


def best_f1_thresholds(s: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, threshold): the score of the largest 2PR / (P + R + 1e-8), the lowest on a tie; 0.5 without positives."""
    c = counts_by_score(s, keys)
    pr, rc = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("all_p")
    f = F.when(F.col("all_p") > 0, F.round(2 * pr * rc / (pr + rc + 1e-8), 12))
    best = c.withColumn("f", f).groupBy(*keys).agg(F.max(F.struct("f", (-F.col("score")).alias("s"))).alias("m"))
    return best.select(*keys, F.when(F.col("m.f").isNotNull(), -F.col("m.s")).otherwise(0.5).alias("threshold"))


def grid_thresholds(s: DataFrame, keys: list[str], grid: tuple[float, ...] = GRID) -> DataFrame:
    """(*keys, threshold, f1): the first grid point of the largest F1; 0.5 where all are 0. One pass, counting conditionally."""
    aggs = []
    for i, t in enumerate(grid):
        hit = F.col("score") >= t
        aggs += [F.sum(F.when(hit, F.col("y")).otherwise(0)).alias(f"tp{i}"), F.sum(F.when(hit, 1 - F.col("y")).otherwise(0)).alias(f"fp{i}")]
    g = s.groupBy(*keys).agg(*aggs, F.sum("y").alias("all_p"))
    cells = F.array(*[F.struct(F.round(_f1(F.col(f"tp{i}"), F.col(f"fp{i}"), F.col("all_p") - F.col(f"tp{i}")), 12).alias("f1"), F.lit(-t).alias("t")) for i, t in enumerate(grid)])
    g = g.withColumn("m", F.array_max(cells))
    return g.select(*keys, F.when(F.col("m.f1") > 0, -F.col("m.t")).otherwise(0.5).alias("threshold"), F.col("m.f1").alias("f1"))


def confusion(s: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, tp, fp, fn, tn, f1) at each label's threshold. thresholds has a row per label."""
    x = s.join(F.broadcast(thresholds.select(*keys, "threshold")), keys) if keys else s.join(F.broadcast(thresholds.select("threshold")))
    hit, y = F.col("score") >= F.col("threshold"), F.col("y") == 1
    c = lambda k: F.count(F.when(k, 1))
    g = x.groupBy(*keys).agg(c(hit & y).alias("tp"), c(hit & ~y).alias("fp"), c(~hit & y).alias("fn"), c(~hit & ~y).alias("tn"))
    return g.withColumn("f1", _f1(F.col("tp"), F.col("fp"), F.col("fn")))


def binding_rates(predicted: DataFrame, known: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(protein_id, n_predicted, rate, known_positives, success_ratio): share of all samples at or over the threshold, and of known positives."""
    x = predicted.join(known, ["sample_id", "protein_id"], "left")
    hit = F.col("score") >= threshold
    g = x.groupBy("protein_id").agg(F.count("*").alias("n_predicted"), F.avg(hit.cast("double")).alias("rate"), F.count(F.when(F.col("y") == 1, 1)).alias("known_positives"), F.count(F.when((F.col("y") == 1) & hit, 1)).alias("hits"))
    return g.select("protein_id", "n_predicted", "rate", "known_positives", F.when(F.col("known_positives") > 0, F.col("hits") / F.col("known_positives")).alias("success_ratio"))


def calibration(s: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, n, mean_score, positive_share) of the uniform bins that aren't empty; a score of 1 is in the last."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int")
    return s.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("y").alias("positive_share"))


def score_histogram(s: DataFrame, bins: int = 50) -> DataFrame:
    b = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int")
    return s.groupBy("y", b.alias("bin")).agg(F.count("*").alias("n"))


def average_output(predicted: DataFrame, known: DataFrame) -> DataFrame:
    """(protein_id, avg_output_sum): the mean of the samples' score sums over the samples in which the label is known."""
    total = predicted.groupBy("sample_id").agg(F.sum("score").alias("total"))
    return known.select("sample_id", "protein_id").join(total, "sample_id").groupBy("protein_id").agg(F.avg("total").alias("avg_output_sum"))


def brier_and_log_loss(s: DataFrame, keys: list[str], eps: float = 1e-15) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("score")))
    y = F.col("y").cast("double")
    return s.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("score") - y) * (F.col("score") - y)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def masked_loss(predicted: DataFrame, known: DataFrame, positive_weight: float = 1.0, unknown_weight: float = 0.1) -> DataFrame:
    """(known_loss, unknown_loss, loss): weighted cross-entropy on known labels, and that of unknown ones to zero, weighted."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("score")))
    x = predicted.withColumn("logit", F.log(p / (1 - p))).join(known, ["sample_id", "protein_id"], "left")
    y = F.coalesce("y", F.lit(0)).cast("double")
    bce = binary_cross_entropy(F.col("logit"), y)
    w = F.when(F.col("y") == 1, F.lit(positive_weight)).otherwise(F.lit(1.0))
    g = x.agg(F.avg(F.when(F.col("y").isNotNull(), bce * w)).alias("known_loss"), F.avg(F.when(F.col("y").isNull(), bce)).alias("unknown_loss"))
    return g.withColumn("loss", F.col("known_loss") + unknown_weight * F.col("unknown_loss"))


def top_k(predicted: DataFrame, k: int, by: str = "sample_id", item: str = "protein_id", value: str = "score") -> DataFrame:
    """The k items of the largest value of each group, ties by item, with rank."""
    w = Window.partitionBy(by).orderBy(F.desc(value), item)
    return predicted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(by, "rank", item, value)


def threshold_or_known(predicted: DataFrame, known: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(sample_id, protein_id, score, y): pairs at or over the threshold or known; a known pair without prediction scores 0."""
    x = predicted.join(known, ["sample_id", "protein_id"], "full_outer").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return x.where((F.col("score") >= threshold) | F.col("y").isNotNull()).select("sample_id", "protein_id", "score", "y")


def metric_summary(per_label: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, n_defined, mean, lowest, highest, median) over labels; undefined ones are left out."""
    x = per_label.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("x.metric", "x.v")
    return x.groupBy("metric").agg(F.count("v").alias("n_defined"), F.avg("v").alias("mean"), F.min("v").alias("lowest"), F.max("v").alias("highest"), F.median("v").alias("median"))


def at_least(per_label: DataFrame, column: str, lines: tuple[float, ...]) -> DataFrame:
    """(line, n_at_least, n_defined): how many labels reach each line."""
    x = per_label.where(F.col(column).isNotNull()).select(F.col(column), F.explode(F.array(*[F.lit(v) for v in lines])).alias("line"))
    return x.groupBy("line").agg(F.count(F.when(F.col(column) >= F.col("line"), 1)).alias("n_at_least"), F.count("*").alias("n_defined"))


def fold_auroc(p: DataFrame, known: DataFrame) -> DataFrame:
    """(config_id, protein_id, n_folds, mean_auc): the area of each fold, seeds averaged first, then the mean over folds."""
    s = p.where(F.col("score").between(0, 1) & F.col("fold").isNotNull()).groupBy("config_id", "fold", "sample_id", "protein_id").agg(F.round(F.avg("score"), 6).alias("score"))
    a = rank_auc(s.join(known, ["sample_id", "protein_id"]), ["config_id", "protein_id", "fold"])
    return a.groupBy("config_id", "protein_id").agg(F.count("auc").alias("n_folds"), F.avg("auc").alias("mean_auc"))


def eligible(p: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """(protein_id): labels with at least so many known positives and negatives in every fold that scores them."""
    f = p.where("fold is not null").select("fold", "sample_id", "protein_id").distinct().join(known, ["sample_id", "protein_id"])
    per = f.groupBy("protein_id", "fold").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    return per.groupBy("protein_id").agg(F.min(F.least("a", "b")).alias("m")).where(F.col("m") >= least).select("protein_id")


def _poisson_weight(replicate: Column | str, cluster: Column | str, seed: int) -> Column:
    """How often a cluster is drawn in a replicate: Poisson with mean 1, from a hash."""
    u = F.pmod(F.xxhash64(F.lit(seed), replicate, cluster), F.lit(1 << 30)) / float(1 << 30)
    weight, cdf, term = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(8):
        cdf += term
        weight = weight + F.when(u >= cdf, 1).otherwise(0)
        term /= k + 1
    return weight


def bootstrap_auroc(s: DataFrame, cluster: str, replicates: int = 2000, seed: int = 20260925, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, replicate, auc) of the pooled labels: clusters are drawn with Poisson(1) weights from a hash of replicate and cluster.

    Rows are counted by cluster and score first; clusters that a replicate doesn't draw send nothing on.
    """
    r = s.groupBy(*keys, cluster, "score").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).withColumn("w", _poisson_weight("replicate", cluster, seed)).where("w > 0")
    g = r.groupBy(*keys, "replicate", "score").agg(F.sum(F.col("w") * F.col("p")).alias("p"), F.sum(F.col("w") * F.col("n")).alias("n"))
    w = Window.partitionBy(*keys, "replicate").orderBy("score")
    g = g.withColumn("rank", F.sum("n").over(w) - F.col("n") + (F.col("n") + 1) / 2)
    x = g.groupBy(*keys, "replicate").agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return x.select(*keys, "replicate", auc_from_ranks(F.col("r"), F.col("p"), F.col("q")).alias("auc"))


def paired_differences(s: DataFrame, by: str, cluster: str, replicates: int = 2000, seed: int = 20260925) -> DataFrame:
    """(one, other, n, mean, lower, upper): of each two values of `by` (one < other, a handful of configurations) the difference of
    their areas over the same draws of clusters: mean and the 2.5 and 97.5 percent points over the replicates in which both are defined."""
    a = bootstrap_auroc(s, cluster, replicates, seed, (by,)).where("auc is not null")
    x = a.select(F.col(by).alias("one"), "replicate", F.col("auc").alias("a")).join(a.select(F.col(by).alias("other"), "replicate", F.col("auc").alias("b")), "replicate").where("one < other").withColumn("d", F.col("a") - F.col("b"))
    return x.groupBy("one", "other").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.percentile("d", F.lit(0.025)).alias("lower"), F.percentile("d", F.lit(0.975)).alias("upper"))


def epoch_loss(batches: DataFrame, keys: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """(*keys, loss, n): the mean of batch losses (loss, n) weighted by their numbers of samples; batches without a loss or samples say nothing."""
    ok = batches.where("loss is not null and n > 0")
    return ok.groupBy(*keys).agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"), F.sum("n").alias("n"))


def find_positive(known: DataFrame, protein_id: int, n: int = 20) -> DataFrame:
    """The first n samples, by sample id, in which the label is known positive."""
    return known.where((F.col("protein_id") == protein_id) & (F.col("y") == 1)).select("sample_id").orderBy("sample_id").limit(n)


def find_multi_positive(known: DataFrame, n: int = 20) -> DataFrame:
    return known.groupBy("sample_id").agg(F.sum("y").alias("positives")).where("positives > 1").orderBy("sample_id").limit(n)


def evenly_spaced(per_label: DataFrame, column: str, n: int, item: str = "protein_id") -> DataFrame:
    """(rank, item, column): n labels evenly spaced in the order of a metric, best first; undefined ones are left out. A row per label."""
    one = Window.partitionBy()
    x = per_label.where(F.col(column).isNotNull()).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(column), item))).withColumn("all_", F.count("*").over(one))
    step = F.greatest(F.lit(1), F.floor(F.col("all_") / n))
    return x.where((F.pmod(F.col("rank") - 1, step) == 0) & ((F.col("rank") - 1) / step < n)).select("rank", item, column)
