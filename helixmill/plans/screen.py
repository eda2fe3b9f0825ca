"""Queries on windows, labels and composition, and the deterministic sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import hashing as H
from helixmill.functions import sequence as Q
from helixmill.operators import audit as A
from helixmill.operators import controls as C
from helixmill.operators import sampling as P
from helixmill.plans import sql
from helixmill.plans.packed import protein_ids

SEED = 20260916


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def records(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "tiny_coordinates_dataset")


def window_text(spark: SparkSession, d: str) -> DataFrame:
    return Q.window_text(records(spark, d))


def observations(spark: SparkSession, d: str) -> DataFrame:
    return A.label_observations(records(spark, d), protein_ids(_t(spark, d, "proteins")))


def windows_read(spark: SparkSession, d: str) -> DataFrame:
    return window_text(spark, d)


def one_hot_problems(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy(Q.one_hot_problem("sequence", 500).alias("problem")).agg(F.count("*").alias("n"))


def decode_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Strict cells decoded and encoded again: how many come back equal."""
    s = Q.decode_strict(records(spark, d), with_cell=True).select("seq", (Q.encode_bases("seq") == F.col("sequence")).alias("equal"), F.length("seq").alias("bases"))
    return s.agg(F.count("bases").alias("n"), F.count(F.when(F.col("equal"), 1)).alias("n_equal"), F.sum("bases").alias("bases"))


def strict_decode(spark: SparkSession, d: str) -> DataFrame:
    return Q.decode_strict(records(spark, d)).distinct()


def reverse_complements(spark: SparkSession, d: str) -> DataFrame:
    return window_text(spark, d).select("row_index", Q.reverse_complement("seq").alias("seq"))


def composition(spark: SparkSession, d: str) -> DataFrame:
    """GC of the window, of its bits' middle 101 bases, entropy and deciles."""
    w = window_text(spark, d)
    return w.select("row_index", _r(Q.gc_fraction("seq")).alias("gc"), _r(Q.gc_fraction(Q.center("seq", 101))).alias("gc_101"), _r(Q.entropy("seq")).alias("entropy"), Q.gc_decile("seq").alias("gc_decile"), Q.low_complexity_decile("seq").alias("complexity_decile"))


def base_classes(spark: SparkSession, d: str) -> DataFrame:
    c = Q.base_classes("s")
    s = records(spark, d).select(F.coalesce("sequence", F.lit("")).alias("s")).select(*[v.alias(k) for k, v in c.items()])
    x = s.agg(*[F.sum(k).alias(k) for k in c])
    return x.withColumn("masking", F.when(F.col("lower") > 0, "soft").otherwise("unmasked"))


def dinucleotide_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.dinucleotides(window_text(spark, d)).groupBy("pair").agg(F.count("*").alias("n"))


def label_problems(spark: SparkSession, d: str) -> DataFrame:
    return A.label_problems(records(spark, d), protein_ids(_t(spark, d, "proteins")))


def label_observation_rows(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d)


def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.audit_summary(records(spark, d), observations(spark, d)).withColumn("mean_known", _r("mean_known"))


def label_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.class_counts(observations(spark, d))


def mean_gc_by_class(spark: SparkSession, d: str) -> DataFrame:
    return A.mean_gc_by_class(window_text(spark, d), observations(spark, d)).withColumn("mean_gc", _r("mean_gc"))


def gc_auc_by_protein(spark: SparkSession, d: str) -> DataFrame:
    a = A.gc_auc(window_text(spark, d), observations(spark, d))
    return a.withColumn("auc", _r("auc")).withColumn("adjusted", _r("adjusted"))


def gc_auc_center(spark: SparkSession, d: str) -> DataFrame:
    a = A.gc_auc(window_text(spark, d), observations(spark, d), 101)
    return a.withColumn("auc", _r("auc")).withColumn("adjusted", _r("adjusted"))


def macro_auc(spark: SparkSession, d: str) -> DataFrame:
    m = A.macro_auc(A.gc_auc(window_text(spark, d), observations(spark, d)))
    return m.select("n_defined", _r("macro_direct").alias("macro_direct"), _r("macro_adjusted").alias("macro_adjusted"))


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where("row_index is not null").select("row_index", F.concat(F.lit("row_"), F.col("row_index").cast("string")).alias("sample_id")).distinct()


def hash_ranks(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sample_id")
    return _ids(spark, d).select("sample_id", H.label_blind_rank(SEED, s).alias("blind"), H.quota_rank(SEED, s, F.lit(7), F.lit("positive")).alias("quota"), H.control_seed(SEED, s, 0).alias("control"), H.content_fingerprint(SEED, s, F.lit(None).cast("string")).alias("fingerprint"))


def representative_sample(spark: SparkSession, d: str) -> DataFrame:
    """The 1,000 records of the lowest label-blind rank, with the rank's order."""
    return P.representatives(_ids(spark, d), 1000, SEED)


def quota_candidates(spark: SparkSession, d: str) -> DataFrame:
    return P.quota_candidates(observations(spark, d), P.representatives(_ids(spark, d), 1000, SEED), SEED, 5)


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """1,000 representatives, quotas of 5 per protein and class as far as they go, filled up to 2,000."""
    return P.build_sample(_ids(spark, d), observations(spark, d), 2000, 1000, 5, 5, SEED, strict=False)


def shuffled_controls(spark: SparkSession, d: str) -> DataFrame:
    """A dinucleotide shuffle of every window without unreadable bases."""
    return C.shuffled_controls(window_text(spark, d).where("length(seq) > 2 and not contains(seq, 'N')"), SEED)


def control_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Every control keeps its window's dinucleotides and ends; differing counts are 0."""
    w = window_text(spark, d).where("length(seq) > 2 and not contains(seq, 'N')")
    return C.control_invariants(w, C.shuffled_controls(w, SEED))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [windows_read, one_hot_problems, decode_round_trip, strict_decode, reverse_complements, composition, base_classes, dinucleotide_counts, label_problems, label_observation_rows, audit_summary, label_class_counts]
    own += [mean_gc_by_class, gc_auc_by_protein, gc_auc_center, macro_auc, hash_ranks, representative_sample, quota_candidates, stratified_sample, shuffled_controls, control_invariants]
    return {f.__name__: f for f in own}


_GC = "case when length({0}) = 0 then 0.0::double else length(regexp_replace({0}, '[^GC]', '', 'g')) / cast(length({0}) as double) end"
_MID = "case when length(seq) <= 101 then seq else substr(seq, cast(floor((length(seq) - 101) / 2) as int) + 1, 101) end"


def _auc(mid: bool) -> str:
    g = _GC.format("q")
    both = sql.WIN + ", " + sql.OBS[len(sql.REC) + 2 :]
    return f"""with {both}, s as (select protein_id, y, {g} sc from (select row_index, {_MID if mid else 'seq'} q from win) join obs using (row_index)),
r as (select protein_id, y, rank() over (partition by protein_id order by sc) + (count(*) over (partition by protein_id, sc) - 1) / 2.0::double rk from s),
a as (select protein_id, sum(y) p, sum(1 - y) n, sum(case when y = 1 then rk else 0 end) rs from r group by 1),
auc as (select protein_id, cast(p as bigint) positives, cast(n as bigint) negatives, case when p > 0 and n > 0 then (rs - p * (p + 1) / 2.0::double) / (cast(p as double) * n) end auc from a)"""


def oracle_sql() -> dict[str, str]:
    win, obs = sql.WIN, sql.OBS
    f = lambda x: f"length(regexp_replace(seq, '[^{x}]', '', 'g'))"
    term = lambda x: f"(case when {x} > 0 then -({x} / cast(tt as double)) * log2({x} / cast(tt as double)) else 0 end)"
    ids = "ids as (select distinct row_index, 'row_' || row_index sample_id from tiny_coordinates_dataset where row_index is not null)"
    us = "chr(31)"
    blind = f"substr(sha256('{SEED}' || {us} || 'label_blind' || {us} || sample_id), 1, 16)"
    auc_out = "select protein_id, positives, negatives, round(auc, 9) auc, round(greatest(auc, 1 - auc), 9) adjusted from auc"
    rep = f"{ids}, rk as (select *, {blind} blind from ids), rep as (select row_index, sample_id, cast(row_number() over (order by blind, sample_id) as int) rank from rk qualify row_number() over (order by blind, sample_id) <= 1000)"
    return {
        "windows_read": f"with {win} select row_index, seq from win",
        "one_hot_problems": "select case when sequence is null or length(sequence) <> 2000 then 'length' when length(regexp_replace(sequence, '[^1]', '', 'g')) <> 500 or length(regexp_replace(sequence, '[^0]', '', 'g')) <> 1500 then 'counts' when not regexp_full_match(sequence, '(1000|0100|0010|0001)+') then 'groups' end problem, count(*) n from tiny_coordinates_dataset group by 1",
        "decode_round_trip": "select count(*) n, count(*) n_equal, cast(sum(length(sequence) / 4) as bigint) bases from tiny_coordinates_dataset where row_index is not null and regexp_full_match(sequence, '(1000|0100|0010|0001)+')",
        "strict_decode": f"with {win}, ok as (select distinct row_index from tiny_coordinates_dataset where row_index is not null and regexp_full_match(sequence, '(1000|0100|0010|0001)+')) select row_index, seq from win join ok using (row_index)",
        "reverse_complements": f"with {win} select row_index, reverse(translate(seq, 'ACGT', 'TGCA')) seq from win",
        "composition": f"with {win}, c as (select row_index, {_GC.format('seq')} gc, {_GC.format('(' + _MID + ')')} gc_101, {f('A')} a, {f('C')} c, {f('G')} g, {f('T')} t, {f('ACGT')} tt from win), e as (select *, case when tt = 0 then 0.0::double else {term('a')} + {term('c')} + {term('g')} + {term('t')} end entropy from c) select row_index, round(gc, 9) gc, round(gc_101, 9) gc_101, round(entropy, 9) entropy, cast(least(9, floor(gc * 10)) as int) gc_decile, cast(least(9, floor(greatest(0, least(1, entropy / 2.0::double)) * 10)) as int) complexity_decile from e",
        "base_classes": "with s as (select coalesce(sequence, '') s from tiny_coordinates_dataset), c as (select length(s) l, length(regexp_replace(s, '[^ACGT]', '', 'g')) u, length(regexp_replace(s, '[^acgt]', '', 'g')) w from s) select cast(sum(u) as bigint) \"upper\", cast(sum(w) as bigint) \"lower\", cast(sum(l - u - w) as bigint) other, case when sum(w) > 0 then 'soft' else 'unmasked' end masking from c",
        "dinucleotide_counts": f"with {win}, p as (select substr(seq, i, 2) pair from (select seq, unnest(range(1, length(seq))) i from win where length(seq) > 1)) select pair, count(*) n from p group by 1",
        "label_problems": f"with {sql.VAL}, p as (select row_index, max(abs(v) > 122) out_of_range, max(v = 0) \"zero\", count(*) > count(distinct v) repeated, count(distinct v) > count(distinct abs(v)) contradicting from val group by 1) select * from p where out_of_range or \"zero\" or repeated or contradicting",
        "label_observation_rows": f"with {obs} select row_index, protein_id, y from obs",
        "audit_summary": f"with {obs}, per as (select row_index, count(*) k, sum(y) p from obs group by 1), n as (select count(*) n from rec) select n n_records, cast(sum(k) as bigint) known, cast(sum(p) as bigint) positive, cast(sum(k) - sum(p) as bigint) negative, count(*) filter (p >= 2) multi_positive, round(sum(k) / cast(n as double), 9) mean_known from per, n group by n",
        "label_class_counts": f"with {obs}, ids as (select cast(unnest(range(1, 123)) as int) protein_id) select protein_id, cast(coalesce(sum(y), 0) as bigint) positive, cast(coalesce(sum(1 - y), 0) as bigint) negative, count(y) known from ids left join obs using (protein_id) group by 1",
        "mean_gc_by_class": f"with {win}, {obs[len(sql.REC) + 2:]} select y, count(*) n, round(avg({_GC.format('seq')}), 9) mean_gc from win join obs using (row_index) group by y",
        "gc_auc_by_protein": f"{_auc(False)} {auc_out}",
        "gc_auc_center": f"{_auc(True)} {auc_out}",
        "macro_auc": f"{_auc(False)} select count(auc) n_defined, round(avg(auc), 9) macro_direct, round(avg(greatest(auc, 1 - auc)), 9) macro_adjusted from auc",
        "hash_ranks": f"with {ids} select sample_id, {blind} blind, substr(sha256('{SEED}' || {us} || sample_id || {us} || '7' || {us} || 'positive'), 1, 16) quota, substr(sha256('{SEED}' || {us} || 'control' || {us} || sample_id || {us} || '0'), 1, 16) control, sha256('{SEED}' || {us} || sample_id || {us} || 'None') fingerprint from ids",
        "representative_sample": f"with {rep} select * from rep",
        "quota_candidates": f"with {obs}, {rep}, c as (select protein_id, y, 'row_' || row_index sample_id from obs where row_index not in (select row_index from rep)), k as (select *, cast(row_number() over (partition by protein_id, y order by substr(sha256('{SEED}' || {us} || sample_id || {us} || protein_id || {us} || case y when 1 then 'positive' else 'negative' end), 1, 16), sample_id) as int) rank from c) select protein_id, y, rank, sample_id from k where rank <= 5",
        "control_invariants": f"with {win} select count(*) n_controls, cast(0 as bigint) other_dinucleotides, cast(0 as bigint) other_ends, cast(0 as bigint) equal_sequences from win where length(seq) > 2 and not contains(seq, 'N')",
    }
