"""Queries on alignment records, mapping categories and retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.sequence import gc_decile, low_complexity_decile, window_text
from helixmill.operators import alignment as A
from helixmill.operators import summaries as S
from helixmill.operators.audit import label_observations
from helixmill.plans import sql
from helixmill.plans.packed import protein_ids
from helixmill.session import materialize


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    return A.mapped_records(_t(spark, d, "alignment_records"))


def loci(spark: SparkSession, d: str) -> DataFrame:
    return A.candidate_loci(A.collinear_groups(A.aligned_blocks(records(spark, d))))


def mapping(spark: SparkSession, d: str) -> DataFrame:
    """One row per expected or observed query, with its stratum; queries without a stratum are the controls."""
    a = _t(spark, d, "sample_assignments").where("sample_id is not null")
    ids = _t(spark, d, "alignment_records").where("query_name is not null").select("query_name").unionByName(a.select(F.col("sample_id").alias("query_name")))
    m = A.classify(loci(spark, d), ids, A.occurrence_counts(A.perfect_hits(records(spark, d))))
    asg = a.groupBy(F.col("sample_id").alias("query_name")).agg(F.min("stratum").alias("stratum"))
    return S.with_usability(m.join(asg, "query_name", "left").withColumn("is_control", F.col("stratum").isNull()))


def _r(c: Column | str, n: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def sam_flags(spark: SparkSession, d: str) -> DataFrame:
    from helixmill.functions import names as N

    f = F.col("flag")
    t = _t(spark, d, "alignment_records")
    return t.groupBy("flag").agg(F.count("*").alias("n")).select("flag", N.flag_set(f, 4).alias("unmapped"), N.flag_set(f, 16).alias("reverse"), N.flag_set(f, 256).alias("secondary"), N.flag_set(f, 2048).alias("supplementary"), N.is_primary(f).alias("is_primary"), "n")


def cigar_operations(spark: SparkSession, d: str) -> DataFrame:
    return A.cigar_ops(records(spark, d)).select("ord", "k", "n", "op")


def cigar_problems(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "alignment_records").groupBy(A.cigar_problem(F.col("cigar")).alias("problem")).agg(F.count("*").alias("n"))


_BLOCK = ["ord", "block", "query_name", "chrom", "strand", "ref_start", "ref_end", "t_start", "t_end", "aligned", "matches", "mismatches", "insertions", "deletions", "intron_before"]


def aligned_blocks(spark: SparkSession, d: str) -> DataFrame:
    return A.aligned_blocks(records(spark, d)).select(*[F.col(c).cast("long").alias(c) if c not in ("query_name", "chrom", "strand") else F.col(c) for c in _BLOCK])


def collinear_groups(spark: SparkSession, d: str) -> DataFrame:
    return A.collinear_groups(A.aligned_blocks(records(spark, d))).groupBy("query_name", "chrom", "strand", F.col("grp").cast("int").alias("grp")).agg(F.count("*").alias("n_blocks"), F.min("ord").alias("first_ord"))


_LOCUS = ["query_name", "chrom", "strand", "n_blocks", "ref_start", "ref_end", "aligned", "matches", "mismatches", "insertions", "deletions", "mapq", "as_score", "is_primary", "intron_lengths", "rank"]


def candidate_loci(spark: SparkSession, d: str) -> DataFrame:
    return loci(spark, d).select(*[F.col(c).cast("long").alias(c) if c in ("ref_start", "ref_end") else F.col(c) for c in _LOCUS], _r("coverage").alias("coverage"), _r("identity").alias("identity"))


def best_two_loci(spark: SparkSession, d: str) -> DataFrame:
    return candidate_loci(spark, d).where("rank <= 2").select("query_name", "rank", "chrom", "strand", "ref_start", "as_score", "coverage", "identity")


def exact_hits(spark: SparkSession, d: str) -> DataFrame:
    return A.perfect_hits(records(spark, d))


def occurrence_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.occurrence_counts(A.perfect_hits(records(spark, d)))


def mapping_rows(spark: SparkSession, d: str) -> DataFrame:
    cols = ["query_name", "chrom", "strand", "as_score", "mapq", "n_blocks", "intron_lengths", "n_loci", "exact_hits", "primary_category", "splice_category", "near_tied", "usable", "stratum"]
    m = mapping(spark, d)
    return m.select(*cols, F.col("ref_start").cast("long").alias("ref_start"), F.col("ref_end").cast("long").alias("ref_end"), _r("coverage").alias("coverage"), _r("identity").alias("identity"))


def category_table(spark: SparkSession, d: str) -> DataFrame:
    return S.category_table(mapping(spark, d))


def category_rates(spark: SparkSession, d: str) -> DataFrame:
    return S.rounded(S.category_rates(mapping(spark, d)))


def usable_rates(spark: SparkSession, d: str) -> DataFrame:
    return S.rounded(S.usable_rates(mapping(spark, d)))


def contiguous_or_rescued(spark: SparkSession, d: str) -> DataFrame:
    return S.contiguous_or_rescued(mapping(spark, d))


def quality_deciles(spark: SparkSession, d: str) -> DataFrame:
    return S.quality_deciles(mapping(spark, d))


def strand_locus(spark: SparkSession, d: str) -> DataFrame:
    return S.strand_locus(mapping(spark, d)).withColumn("mean_rows_per_locus", _r("mean_rows_per_locus"))


def near_tied_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return S.near_tied_sensitivity(mapping(spark, d))


def control_alerts(spark: SparkSession, d: str) -> DataFrame:
    return S.control_alerts(mapping(spark, d))


def exact_discordance(spark: SparkSession, d: str) -> DataFrame:
    return S.exact_discordance(mapping(spark, d))


def _observations(spark: SparkSession, d: str) -> DataFrame:
    o = label_observations(_t(spark, d, "tiny_coordinates_dataset"), protein_ids(_t(spark, d, "proteins")))
    return o.select(F.concat(F.lit("row_"), F.col("row_index").cast("string")).alias("query_name"), "protein_id", "y")


def retention_by_class(spark: SparkSession, d: str) -> DataFrame:
    return S.rounded(S.retention_by_class(mapping(spark, d), _observations(spark, d)))


def retention_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = S.retention_gaps(S.retention_by_class(mapping(spark, d), _observations(spark, d)))
    return g.withColumn("gap", _r("gap"))


def _deciles(spark: SparkSession, d: str) -> DataFrame:
    w = window_text(_t(spark, d, "tiny_coordinates_dataset"))
    return w.select(F.concat(F.lit("row_"), F.col("row_index").cast("string")).alias("query_name"), gc_decile("seq").alias("gc_decile"), low_complexity_decile("seq").alias("complexity_decile"))


def retention_by_gc(spark: SparkSession, d: str) -> DataFrame:
    return S.rounded(S.retention_by(mapping(spark, d).join(_deciles(spark, d), "query_name"), "gc_decile"))


def retention_by_complexity(spark: SparkSession, d: str) -> DataFrame:
    return S.rounded(S.retention_by(mapping(spark, d).join(_deciles(spark, d), "query_name"), "complexity_decile"))


def retention_by_contig(spark: SparkSession, d: str) -> DataFrame:
    m = mapping(spark, d).where("chrom is not null").withColumn("contig", F.when(F.col("chrom").rlike("^chr[0-9]+$"), "chromosome").when(F.col("chrom").rlike("^ctg_"), "unplaced").otherwise("other"))
    return S.rounded(S.retention_by(m, "contig"))


def build_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two builds of the mapping: all contigs, and chromosomes only."""
    part = A.mapped_records(_t(spark, d, "alignment_records").where(F.col("chrom").rlike("^chr")))
    two = A.classify(A.candidate_loci(A.collinear_groups(A.aligned_blocks(part))), part.select("query_name"), A.occurrence_counts(A.perfect_hits(part)))
    return S.compare_builds(mapping(spark, d), S.with_usability(two))


def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return S.reconcile(_t(spark, d, "sample_assignments"), materialize(mapping(spark, d), "mapping"))  # read by each check


def stratum_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "sample_assignments").select("sample_id", "stratum").distinct().groupBy("stratum").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [sam_flags, cigar_operations, cigar_problems, aligned_blocks, collinear_groups, candidate_loci, best_two_loci, exact_hits, occurrence_counts, mapping_rows, category_table, category_rates, usable_rates, contiguous_or_rescued]
    own += [quality_deciles, strand_locus, near_tied_sensitivity, control_alerts, exact_discordance, retention_by_class, retention_gaps, retention_by_gc, retention_by_complexity, retention_by_contig, build_comparison, reconciliation, stratum_counts]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    a, m, w = sql.ALN, sql.MAP, sql.wilson
    rate = lambda k, n: f"{k} successes, {n} total, {w(k, n)}"
    locus = "query_name, chrom, strand, n_blocks, cast(ref_start as bigint) ref_start, cast(ref_end as bigint) ref_end, aligned, matches, mismatches, insertions, deletions, mapq, as_score, is_primary, intron_lengths, rank, round(coverage, 9) coverage, round(identity, 9) identity"
    scopes = "(select *, unnest(['combined', 'primary', 'splice']) scope from {}) "
    use = "case scope when 'combined' then usable when 'primary' then use_primary else use_splice end"
    win = sql.WIN.replace(sql.REC, sql.REC)
    obs_map = sql.OBS + ", " + m + ", ob as (select 'row_' || row_index query_name, protein_id, y from obs), base as (select query_name, usable, use_primary, use_splice from mp where not is_control)"
    rc = f"select scope, protein_id, y, count(*) filter ({use}) k, count(*) n from (select *, unnest(['combined', 'primary', 'splice']) scope from base join ob using (query_name)) group by grouping sets ((scope, protein_id, y), (scope, y))"
    dec = win + ", " + m + """, cnt as (select row_index, length(seq) len, length(regexp_replace(seq, '[^GC]', '', 'g')) gc, length(regexp_replace(seq, '[^A]', '', 'g')) a, length(regexp_replace(seq, '[^C]', '', 'g')) c, length(regexp_replace(seq, '[^G]', '', 'g')) g, length(regexp_replace(seq, '[^T]', '', 'g')) t from win),
ent as (select *, case when len = 0 then 0.0::double else gc / cast(len as double) end gcf, case when a + c + g + t = 0 then 0.0::double else (case when a > 0 then -(a / cast(a + c + g + t as double)) * log2(a / cast(a + c + g + t as double)) else 0 end) + (case when c > 0 then -(c / cast(a + c + g + t as double)) * log2(c / cast(a + c + g + t as double)) else 0 end)
 + (case when g > 0 then -(g / cast(a + c + g + t as double)) * log2(g / cast(a + c + g + t as double)) else 0 end) + (case when t > 0 then -(t / cast(a + c + g + t as double)) * log2(t / cast(a + c + g + t as double)) else 0 end) end ent from cnt),
dec as (select 'row_' || row_index query_name, cast(least(9, floor(greatest(0, least(1, gcf)) * 10)) as int) gc_decile, cast(least(9, floor(greatest(0, least(1, ent / 2.0::double)) * 10)) as int) complexity_decile from ent)"""
    by = lambda col: f"select scope, {col}, {rate(f'count(*) filter ({use})', 'count(*)')} from (select *, unnest(['combined', 'primary', 'splice']) scope from mp join dec using (query_name) where not is_control) group by scope, {col}"
    two = m.replace("from alignment_records where (flag & 4) = 0", "from alignment_records where regexp_matches(chrom, '^chr') and (flag & 4) = 0").replace("select distinct query_name from alignment_records where query_name is not null union select distinct sample_id from sample_assignments where sample_id is not null", "select distinct query_name from ar")
    return {
        "sam_flags": "select flag, (flag & 4) <> 0 unmapped, (flag & 16) <> 0 reverse, (flag & 256) <> 0 secondary, (flag & 2048) <> 0 supplementary, (flag & 2304) = 0 is_primary, count(*) n from alignment_records group by flag",
        "cigar_operations": f"with {a} select ord, cast(k as int) k, n, op from op3",
        "cigar_problems": "select case when not regexp_matches(cigar, '^([0-9]+[A-Za-z=])*$') and cigar <> '*' then 'malformed' when regexp_matches(cigar, '[^0-9MIDNSHX=*]') then 'unsupported' end problem, count(*) n from alignment_records group by 1",
        "aligned_blocks": f"with {a} select ord, cast(blk as bigint) \"block\", query_name, chrom, strand, cast(ref_start as bigint) ref_start, cast(ref_end as bigint) ref_end, cast(t_start as bigint) t_start, cast(t_end as bigint) t_end, cast(aligned as bigint) aligned, cast(matches as bigint) matches, cast(mismatches as bigint) mismatches, cast(insertions as bigint) insertions, cast(deletions as bigint) deletions, cast(intron_before as bigint) intron_before from blk1",
        "collinear_groups": f"with {a} select query_name, chrom, strand, grp, count(*) n_blocks, min(ord) first_ord from grp1 group by 1, 2, 3, 4",
        "candidate_loci": f"with {a} select {locus} from loci",
        "best_two_loci": f"with {a} select query_name, rank, chrom, strand, cast(ref_start as bigint) ref_start, as_score, round(coverage, 9) coverage, round(identity, 9) identity from loci where rank <= 2",
        "exact_hits": f"with {m} select * from hit",
        "occurrence_counts": f"with {m} select * from occ",
        "mapping_rows": f"with {m} select query_name, chrom, strand, cast(ref_start as bigint) ref_start, cast(ref_end as bigint) ref_end, as_score, mapq, n_blocks, intron_lengths, coalesce(n_loci, 0) n_loci, exact_hits, primary_category, splice_category, near_tied, usable, stratum, round(coverage, 9) coverage, round(identity, 9) identity from mp",
        "category_table": f"with {m}, u as (select 'primary' \"mode\", is_control, primary_category category from mp union all select 'splice', is_control, splice_category from mp) select \"mode\", is_control, category, count(*) n from u group by 1, 2, 3",
        "category_rates": f"with {m}, u as (select 'primary' \"mode\", primary_category category from mp where not is_control union all select 'splice', splice_category from mp where not is_control), t as (select count(*) n from mp where not is_control), g as (select \"mode\", category, count(*) k, (select n from t) n from u group by 1, 2) select \"mode\", category, k successes, n total, {w('k', 'n')} from g",
        "usable_rates": f"with {m} select scope, {rate(f'count(*) filter ({use})', 'count(*)')} from {scopes.format('mp')} where not is_control group by scope",
        "contiguous_or_rescued": f"with {m} select case when use_primary then 'contiguous_usable' when use_splice then 'splice_rescued' else 'still_unusable' end part, stratum, count(*) n from mp where not is_control group by 1, 2",
        "quality_deciles": f"with {m}, q as (select unnest(['coverage', 'identity']) field, unnest([coverage, identity]) v from mp where not is_control and coverage is not null) select field, cast(least(9, floor(greatest(0, least(1, v)) * 10)) as int) decile, count(*) n from q group by 1, 2",
        "strand_locus": f"with {m}, g as (select chrom, ref_start, ref_end, strand, count(*) n from mp where not is_control and chrom is not null group by all) select cast(coalesce(sum(n) filter (strand = '+'), 0) as bigint) forward_strand, cast(coalesce(sum(n) filter (strand = '-'), 0) as bigint) reverse_strand, count(*) distinct_loci, coalesce(max(n), 0) max_rows_per_locus, round(coalesce(avg(n), 0), 9) mean_rows_per_locus from g",
        "near_tied_sensitivity": f"with {m}, f as (select unnest(['0.02', '0.05', '0.1']) fraction) select fraction, count(*) filter (list_contains(string_split(near_tied, ';'), fraction)) triggered, count(*) total from mp, f where not is_control group by 1",
        "control_alerts": f"with {m} select query_name, primary_category from mp where is_control and use_primary",
        "exact_discordance": f"with {m}, c as (select *, exact_hits <> 1 discordant from mp where not is_control and coverage = 1 and identity = 1 and not coalesce(sec, false)) select discordant, count(*) n from c group by 1",
        "retention_by_class": f"with {obs_map}, g as ({rc}) select scope, protein_id, y, k successes, n total, {w('k', 'n')} from g",
        "retention_gaps": f"with {obs_map}, g as ({rc}), r as (select scope, protein_id, y, k / cast(n as double) p from g), x as (select scope, protein_id, max(p) filter (y = 1) a, max(p) filter (y = 0) b from r group by 1, 2) select scope, protein_id, round(a - b, 9) gap, abs(a - b) >= cast(0.40 as double) severe_gap, least(a, b) < cast(0.50 as double) severe_retention from x where a is not null and b is not null",
        "retention_by_gc": f"with {dec} {by('gc_decile')}",
        "retention_by_complexity": f"with {dec} {by('complexity_decile')}",
        "retention_by_contig": f"with {m}, dec as (select query_name, case when regexp_matches(chrom, '^chr[0-9]+$') then 'chromosome' when regexp_matches(chrom, '^ctg_') then 'unplaced' else 'other' end contig from mp where chrom is not null) {by('contig')}",
        "build_comparison": f"with o as (with {m} select query_name, primary_category c, usable u from mp), t as (with {two} select query_name, primary_category c, usable u from mp) select count(*) compared, count(*) filter (o.c <> t.c) category_changed, round(avg(case when o.u then 1.0 else 0.0 end), 9) rate_one, round(avg(case when t.u then 1.0 else 0.0 end), 9) rate_two, round(abs(avg(case when o.u then 1.0 else 0.0 end) - avg(case when t.u then 1.0 else 0.0 end)) * 100, 7) gap_points from o join t using (query_name)",
        "reconciliation": f"""with {m}, a as (select distinct sample_id, stratum from sample_assignments), d as (select sample_id from a group by 1 having count(*) > 1)
select 'sample_total' "check", count(distinct sample_id) observed, case when count(*) > 0 then 'passed' else 'failed' end status from a
union all select 'sample_uniqueness', count(*), case when count(*) = 0 then 'passed' else 'failed' end from d
union all select 'representative_count', count(*), case when count(*) > 0 then 'passed' else 'failed' end from a where stratum = 'representative'
union all select 'stratum_partition', count(*), case when count(*) = 0 then 'passed' else 'failed' end from a where stratum is null or stratum not in ('representative', 'quota', 'filler')
union all select 'empty_mapping_results', count(*), case when count(*) > 0 then 'passed' else 'failed' end from mp
union all select 'invalid_category', count(*), case when count(*) = 0 then 'passed' else 'failed' end from mp where primary_category not in ('exact_unique', 'high_conf_unique', 'ambiguous', 'low_quality', 'unmapped')
union all select 'control_count', count(*), case when count(*) > 0 then 'passed' else 'failed' end from mp where is_control
union all select 'unknown_sample_ids', count(*), case when count(*) = 0 then 'passed' else 'failed' end from mp where query_name not in (select sample_id from a where sample_id is not null)
union all select 'one_category_per_row', count(*), case when count(*) = 0 then 'passed' else 'failed' end from (select query_name from mp group by 1 having count(*) > 1)
union all select 'missing_mapping_ids', count(*), case when count(*) = 0 then 'passed' else 'failed' end from a where sample_id is not null and sample_id not in (select query_name from mp)
union all select 'category_row_count', count(*), case when count(*) > 0 then 'passed' else 'failed' end from mp where not is_control""",
        "stratum_counts": "select stratum, count(*) n from (select distinct sample_id, stratum from sample_assignments) group by 1",
    }
