"""Queries on predictions: metrics per label, calibration, co-dependence, folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import codependence as D
from helixmill.operators import evaluation as E
from helixmill.operators.audit import label_observations
from helixmill.plans import sql
from helixmill.plans.packed import protein_ids


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def known(spark: SparkSession, d: str) -> DataFrame:
    o = label_observations(_t(spark, d, "tiny_coordinates_dataset"), protein_ids(_t(spark, d, "proteins")))
    return o.select(F.concat(F.lit("row_"), F.col("row_index").cast("string")).alias("sample_id"), "protein_id", "y")


def predicted(spark: SparkSession, d: str) -> DataFrame:
    return E.latest_predictions(_t(spark, d, "predictions"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return predicted(spark, d).join(known(spark, d), ["sample_id", "protein_id"])


KEY = ["protein_id"]


def prediction_problems(spark: SparkSession, d: str) -> DataFrame:
    return E.contract_problems(_t(spark, d, "predictions"))


def predictions_once(spark: SparkSession, d: str) -> DataFrame:
    return predicted(spark, d)


def auroc_by_label(spark: SparkSession, d: str) -> DataFrame:
    return E.auroc(scored(spark, d), KEY).withColumn("auc", _r("auc"))


def average_precision_by_label(spark: SparkSession, d: str) -> DataFrame:
    return E.average_precision(scored(spark, d), KEY).withColumn("ap", _r("ap"))


def micro_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return E.average_precision(scored(spark, d), []).withColumn("ap", _r("ap"))


def best_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return E.best_f1_thresholds(scored(spark, d), KEY)


def grid_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return E.grid_thresholds(scored(spark, d), KEY).withColumn("f1", _r("f1"))


def confusion_by_label(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return E.confusion(s, E.best_f1_thresholds(s, KEY), KEY).withColumn("f1", _r("f1"))


def confusion_at_half(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    half = s.select("protein_id").distinct().withColumn("threshold", F.lit(0.5))
    return E.confusion(s, half, KEY).withColumn("f1", _r("f1"))


def binding_rates(spark: SparkSession, d: str) -> DataFrame:
    b = E.binding_rates(predicted(spark, d), known(spark, d))
    return b.withColumn("rate", _r("rate")).withColumn("success_ratio", _r("success_ratio")).orderBy(F.desc("rate"), "protein_id")


def calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    return E.calibration(scored(spark, d)).withColumn("mean_score", _r("mean_score")).withColumn("positive_share", _r("positive_share"))


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return E.score_histogram(scored(spark, d))


def average_outputs(spark: SparkSession, d: str) -> DataFrame:
    return E.average_output(predicted(spark, d), known(spark, d)).withColumn("avg_output_sum", _r("avg_output_sum"))


def brier_log_loss(spark: SparkSession, d: str) -> DataFrame:
    return E.brier_and_log_loss(scored(spark, d), KEY).withColumn("brier", _r("brier")).withColumn("log_loss", _r("log_loss"))


def masked_loss(spark: SparkSession, d: str) -> DataFrame:
    m = E.masked_loss(predicted(spark, d), known(spark, d), 2.0)
    return m.select(*[_r(c).alias(c) for c in m.columns])


def top_bindings(spark: SparkSession, d: str) -> DataFrame:
    """The three best-scored labels of every sample."""
    return E.top_k(predicted(spark, d), 3)


def threshold_or_known(spark: SparkSession, d: str) -> DataFrame:
    return E.threshold_or_known(predicted(spark, d), known(spark, d))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return E.auroc(s, KEY).join(E.average_precision(s, KEY), "protein_id").join(E.best_f1_thresholds(s, KEY), "protein_id")


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    m = E.metric_summary(_metrics(spark, d), ["auc", "ap", "threshold"])
    return m.select("metric", "n_defined", *[_r(c).alias(c) for c in ("mean", "lowest", "highest", "median")])


def auc_lines(spark: SparkSession, d: str) -> DataFrame:
    return E.at_least(E.auroc(scored(spark, d), KEY).withColumn("auc", _r("auc")), "auc", (0.5, 0.6, 0.7, 0.8, 0.9))


def best_and_worst_labels(spark: SparkSession, d: str) -> DataFrame:
    """The ten labels of the largest and the ten of the smallest area."""
    a = auroc_by_label(spark, d).where("auc is not null").select("protein_id", "auc")
    top = a.orderBy(F.desc("auc"), "protein_id").limit(10).withColumn("part", F.lit("top"))
    return top.unionByName(a.orderBy("auc", "protein_id").limit(10).withColumn("part", F.lit("bottom")))


def evenly_spaced_labels(spark: SparkSession, d: str) -> DataFrame:
    """Ten labels evenly spaced by area."""
    return E.evenly_spaced(auroc_by_label(spark, d), "auc", 10)


def first_positives(spark: SparkSession, d: str) -> DataFrame:
    return E.find_positive(known(spark, d), 31)


def first_multi_positives(spark: SparkSession, d: str) -> DataFrame:
    return E.find_multi_positive(known(spark, d))


def auroc_by_fold(spark: SparkSession, d: str) -> DataFrame:
    return E.fold_auroc(_t(spark, d, "predictions"), known(spark, d)).withColumn("mean_auc", _r("mean_auc"))


def eligible_labels(spark: SparkSession, d: str) -> DataFrame:
    return E.eligible(_t(spark, d, "predictions"), known(spark, d), 1)


def bootstrap_auroc(spark: SparkSession, d: str) -> DataFrame:
    return E.bootstrap_auroc(scored(spark, d), "sample_id")


def paired_differences(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "predictions").where(F.col("score").between(0, 1)).groupBy("config_id", "sample_id", "protein_id").agg(F.round(F.avg("score"), 6).alias("score"))
    return E.paired_differences(p.where("config_id is not null").join(known(spark, d), ["sample_id", "protein_id"]), "config_id", "sample_id")


def _positives(spark: SparkSession, d: str) -> DataFrame:
    return known(spark, d).where("y = 1").withColumn("score", F.lit(1.0))


def label_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return D.cooccurrence(_positives(spark, d))


def _conditional(spark: SparkSession, d: str) -> DataFrame:
    return D.conditional(D.cooccurrence(_positives(spark, d)), _t(spark, d, "proteins").select("protein_id").distinct())


def conditional_binding(spark: SparkSession, d: str) -> DataFrame:
    return _conditional(spark, d).withColumn("p", _r("p"))


def top_cobinders(spark: SparkSession, d: str) -> DataFrame:
    return D.top_partners(D.cooccurrence(_positives(spark, d)), 5, 2.0)


def asymmetric_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = D.asymmetric_pairs(_conditional(spark, d).withColumn("p", _r("p")), 50)
    return x.select("i", "j", "p_ij", "p_ji", _r("difference").alias("difference"), _r("magnitude").alias("magnitude"))


def profile_cosine(spark: SparkSession, d: str) -> DataFrame:
    return D.profile_cosine(_conditional(spark, d)).withColumn("cosine", _r("cosine"))


def heaviest_labels(spark: SparkSession, d: str) -> DataFrame:
    return D.top_mass(D.cooccurrence(_positives(spark, d)), 20)


def label_clusters(spark: SparkSession, d: str) -> DataFrame:
    return D.clusters(_conditional(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [prediction_problems, predictions_once, auroc_by_label, average_precision_by_label, micro_average_precision, best_thresholds, grid_thresholds, confusion_by_label, confusion_at_half, binding_rates, calibration_curve]
    own += [score_histogram, average_outputs, brier_log_loss, masked_loss, top_bindings, threshold_or_known, metric_summary, auc_lines, best_and_worst_labels, evenly_spaced_labels, first_positives, first_multi_positives, auroc_by_fold, eligible_labels]
    own += [bootstrap_auroc, paired_differences, label_cooccurrence, conditional_binding, top_cobinders, asymmetric_pairs, profile_cosine, heaviest_labels, label_clusters]
    return {f.__name__: f for f in own}


SC = (
    sql.OBS
    + """, kn as (select 'row_' || row_index sample_id, protein_id, y from obs),
pr as (select sample_id, protein_id, round(avg(score), 6) score from (select sample_id, protein_id, fold, seed, window_nt, config_id, config_hash, arg_max(score, struct_pack(a := scored_at, b := score)) score
 from predictions where score between 0 and 1 group by 1, 2, 3, 4, 5, 6, 7) group by 1, 2),
sc as (select pr.*, y from pr join kn using (sample_id, protein_id)),
g as (select protein_id, score, sum(y) p, count(*) n from sc group by 1, 2),
cb as (select *, sum(p) over d tp, sum(n) over d - sum(p) over d fp, sum(p) over w all_p, sum(n - p) over w all_n from g window w as (partition by protein_id), d as (partition by protein_id order by score desc)),
rk as (select protein_id, y, rank() over (partition by protein_id order by score) + (count(*) over (partition by protein_id, score) - 1) / 2.0::double r from sc),
au as (select protein_id, cast(sum(y) as bigint) positives, cast(sum(1 - y) as bigint) negatives, case when sum(y) > 0 and sum(1 - y) > 0 then (sum(case when y = 1 then r else 0 end) - sum(y) * (sum(y) + 1) / 2.0::double) / (cast(sum(y) as double) * sum(1 - y)) end auc from rk group by 1),
ap as (select protein_id, sum(case when all_p > 0 then p / cast(all_p as double) * (tp / cast(tp + fp as double)) end) ap from cb group by 1),
f1s as (select protein_id, score, case when all_p > 0 then round(2 * (tp / cast(tp + fp as double)) * (tp / cast(all_p as double)) / (tp / cast(tp + fp as double) + tp / cast(all_p as double) + cast(1e-8 as double)), 12) end f from cb),
th as (select protein_id, coalesce(arg_min(score, struct_pack(a := -f, b := score)) filter (f is not null), cast(0.5 as double)) threshold from f1s group by 1),
co as (select a.protein_id i, b.protein_id j, cast(count(*) as double) c from kn a join kn b using (sample_id) where a.y = 1 and b.y = 1 group by 1, 2),
cp as (select i, j, case when coalesce(d.c, 0) > 0 then coalesce(co.c, 0) / d.c else cast(0 as double) end p from (select distinct protein_id i from proteins) x cross join (select distinct protein_id j from proteins) y left join co using (i, j) left join (select j, c from co where i = j) d using (j))"""
)


def oracle_sql() -> dict[str, str]:
    w = f"with {SC} "
    conf = lambda t: f"select protein_id, count(*) filter (score >= {t} and y = 1) tp, count(*) filter (score >= {t} and y = 0) fp, count(*) filter (score < {t} and y = 1) fn, count(*) filter (score < {t} and y = 0) tn"
    f1 = "round(case when 2 * tp + fp + fn > 0 then 2 * tp / cast(2 * tp + fp + fn as double) else 0 end, 9) f1"
    p = "greatest(cast(1e-6 as double), least(1 - cast(1e-6 as double), score))"
    return {
        "prediction_problems": "select problem, count(*) n from (select unnest([case when score is null then 'null_score' end, case when not score between 0 and 1 then 'score_out_of_range' end, case when fold is null then 'null_fold' end, case when sample_id is null or protein_id is null then 'null_key' end]) problem from predictions) where problem is not null group by 1",
        "predictions_once": w + "select sample_id, protein_id, score from pr",
        "auroc_by_label": w + "select protein_id, positives, negatives, round(auc, 9) auc from au",
        "average_precision_by_label": w + "select protein_id, round(ap, 9) ap from ap",
        "micro_average_precision": w + ", mg as (select score, sum(y) p, count(*) n from sc group by 1), mc as (select *, sum(p) over (order by score desc) tp, sum(n) over (order by score desc) tn, sum(p) over () ap from mg) select round(sum(p / cast(ap as double) * (tp / cast(tn as double))), 9) ap from mc",
        "best_thresholds": w + "select * from th",
        "grid_thresholds": w + f", t as (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::double t), c as (select protein_id, t, count(*) filter (score >= t and y = 1) tp, count(*) filter (score >= t and y = 0) fp, count(*) filter (score < t and y = 1) fn from sc, t group by 1, 2), f as (select protein_id, t, round(case when 2 * tp + fp + fn > 0 then 2 * tp / cast(2 * tp + fp + fn as double) else 0 end, 12) f1 from c) select protein_id, case when max(f1) > 0 then arg_min(t, struct_pack(a := -f1, b := t)) else cast(0.5 as double) end threshold, round(max(f1), 9) f1 from f group by 1",
        "confusion_by_label": w + f", c as ({conf('threshold')} from sc join th using (protein_id) group by 1) select *, {f1} from c",
        "confusion_at_half": w + f", c as ({conf('0.5')} from sc group by 1) select *, {f1} from c",
        "binding_rates": w + "select protein_id, count(*) n_predicted, round(avg(case when score >= 0.5 then 1.0 else 0.0 end), 9) rate, count(*) filter (y = 1) known_positives, round(count(*) filter (y = 1 and score >= 0.5) / cast(nullif(count(*) filter (y = 1), 0) as double), 9) success_ratio from pr left join kn using (sample_id, protein_id) group by 1",
        "calibration_curve": w + "select cast(least(19, floor(score * 20)) as int) bin, count(*) n, round(avg(score), 9) mean_score, round(avg(y), 9) positive_share from sc group by 1",
        "score_histogram": w + "select y, cast(least(49, floor(score * 50)) as int) bin, count(*) n from sc group by 1, 2",
        "average_outputs": w + "select protein_id, round(avg(t), 9) avg_output_sum from kn join (select sample_id, sum(score) t from pr group by 1) using (sample_id) group by 1",
        "brier_log_loss": w + "select protein_id, count(*) n, round(avg((score - y) * (score - y)), 9) brier, round(avg(-(y * ln(greatest(cast(1e-15 as double), least(1 - cast(1e-15 as double), score))) + (1 - y) * ln(1 - greatest(cast(1e-15 as double), least(1 - cast(1e-15 as double), score))))), 9) log_loss from sc group by 1",
        "masked_loss": w + f", l as (select coalesce(y, 0) y0, y, ln({p} / (1 - {p})) z from pr left join kn using (sample_id, protein_id)), b as (select y, greatest(z, 0) - z * y0 + ln(1 + exp(-abs(z))) l from l), m as (select avg(case when y is not null then l * case when y = 1 then 2 else 1 end end) a, avg(case when y is null then l end) u from b) select round(a, 9) known_loss, round(u, 9) unknown_loss, round(a + cast(0.1 as double) * u, 9) loss from m",
        "top_bindings": w + "select sample_id, rank, protein_id, score from (select *, cast(row_number() over (partition by sample_id order by score desc, protein_id) as int) rank from pr) where rank <= 3",
        "threshold_or_known": w + "select sample_id, protein_id, coalesce(score, 0) score, y from pr full join kn using (sample_id, protein_id) where coalesce(score, 0) >= 0.5 or y is not null",
        "metric_summary": w + ", m as (select unnest(['auc', 'ap', 'threshold']) metric, unnest([auc, ap, threshold]) v from au join ap using (protein_id) join th using (protein_id)) select metric, count(v) n_defined, round(avg(v), 9) mean, round(min(v), 9) lowest, round(max(v), 9) highest, round(median(v), 9) median from m group by 1",
        "auc_lines": w + "select line, count(*) filter (round(auc, 9) >= line) n_at_least, count(*) n_defined from au, (select unnest([0.5, 0.6, 0.7, 0.8, 0.9])::double line) where auc is not null group by 1",
        "best_and_worst_labels": w + ", a as (select protein_id, round(auc, 9) auc from au where auc is not null) (select *, 'top' part from a order by auc desc, protein_id limit 10) union all (select *, 'bottom' from a order by auc, protein_id limit 10)",
        "evenly_spaced_labels": w + ", r as (select protein_id, round(auc, 9) auc, row_number() over (order by round(auc, 9) desc, protein_id) rank, count(*) over () n from au where auc is not null) select cast(rank as int) rank, protein_id, auc from r where (rank - 1) % greatest(1, n // 10) = 0 and (rank - 1) // greatest(1, n // 10) < 10",
        "first_positives": w + "select sample_id from kn where protein_id = 31 and y = 1 order by 1 limit 20",
        "first_multi_positives": w + "select sample_id, cast(sum(y) as bigint) positives from kn group by 1 having sum(y) > 1 order by 1 limit 20",
        "auroc_by_fold": w + ", fs as (select config_id, fold, sample_id, protein_id, round(avg(score), 6) score from predictions where score between 0 and 1 and fold is not null group by 1, 2, 3, 4), fk as (select config_id, fold, protein_id, y, rank() over (partition by config_id, fold, protein_id order by score) + (count(*) over (partition by config_id, fold, protein_id, score) - 1) / 2.0::double r from fs join kn using (sample_id, protein_id)), fa as (select config_id, fold, protein_id, case when sum(y) > 0 and sum(1 - y) > 0 then (sum(case when y = 1 then r else 0 end) - sum(y) * (sum(y) + 1) / 2.0::double) / (cast(sum(y) as double) * sum(1 - y)) end auc from fk group by 1, 2, 3) select config_id, protein_id, count(auc) n_folds, round(avg(auc), 9) mean_auc from fa group by 1, 2",
        "eligible_labels": w + ", f as (select distinct fold, sample_id, protein_id from predictions where fold is not null), c as (select protein_id, fold, sum(y) a, sum(1 - y) b from f join kn using (sample_id, protein_id) group by 1, 2) select protein_id from c group by 1 having min(least(a, b)) >= 1",
        "label_cooccurrence": w + "select * from co",
        "conditional_binding": w + "select i, j, round(p, 9) p from cp",
        "top_cobinders": w + "select j anchor, rank, i partner, c \"value\" from (select *, cast(row_number() over (partition by j order by c desc, i) as int) rank from co where i <> j and j in (select j from co where i = j and c >= 2)) where rank <= 5",
        "asymmetric_pairs": w + ", r as (select i, j, round(p, 9) p from cp) select a.i, a.j, a.p p_ij, b.p p_ji, round(a.p - b.p, 9) difference, round(abs(a.p - b.p), 9) magnitude from r a join r b on a.i = b.j and a.j = b.i where a.i < a.j order by abs(a.p - b.p) desc, a.i, a.j limit 50",
        "profile_cosine": w + ", n as (select j, sqrt(sum(p * p)) n from cp group by 1) select a.j i, b.j j, round(sum(a.p * b.p) / (max(na.n) * max(nb.n)), 9) cosine from cp a join cp b on a.i = b.i and a.j < b.j and a.p <> 0 and b.p <> 0 join n na on na.j = a.j join n nb on nb.j = b.j group by 1, 2",
        "heaviest_labels": w + ", m as (select i protein_id, sum(c) mass from co group by 1 order by mass desc, protein_id limit 20) select * from m",
    }
