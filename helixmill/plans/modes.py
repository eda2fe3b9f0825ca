"""Queries on two alignments of the same queries: contiguous records alone, and all records with the spliced ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import alignment as A
from helixmill.operators import checks as C
from helixmill.operators import modes as M
from helixmill.operators.sampling import first_sources
from helixmill.plans import align, sql
from helixmill.session import materialize


def _loci(records: DataFrame) -> DataFrame:
    return A.candidate_loci(A.collinear_groups(A.aligned_blocks(records)))


def rows(spark: SparkSession, d: str) -> DataFrame:
    """Mapping rows of both modes, written once."""
    sam = align._t(spark, d, "alignment_records")
    contiguous = A.mapped_records(sam.where(~F.col("cigar").contains("N")))
    everything = A.mapped_records(sam)
    expected = align._t(spark, d, "sample_assignments").select("sample_id", "stratum")
    return materialize(M.mode_rows(_loci(contiguous), _loci(everything), expected, A.occurrence_counts(A.perfect_hits(everything)), "one"), "mode_rows")


def mode_rows(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d)
    share = [c for c in r.columns if c.endswith(("coverage", "identity"))]
    whole = [c for c in r.columns if c.endswith(("start", "end", "block_count", "mapq", "alignment_score"))]
    return r.select(*[F.round(c, 9).alias(c) if c in share else F.col(c).cast("long").alias(c) if c in whole else F.col(c) for c in r.columns])


def _contigs(r: DataFrame) -> DataFrame:
    """Categories of the contigs by their names, as the tables have no assembly report of them; those of neither kind aren't listed."""
    name = F.when(F.col("chrom").rlike("^chr[0-9]+$"), "chromosome").when(F.col("chrom").rlike("^ctg_"), "unplaced")
    return r.where("chrom is not null").select(F.col("chrom").alias("contig"), name.alias("category")).distinct().where("category is not null")


def build_summary(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d)
    return M.summary_cells(M.build_summary(r, align._observations(spark, d), materialize(align._deciles(spark, d), "deciles"), _contigs(r)))


def expected_counts(spark: SparkSession, d: str) -> DataFrame:
    """The sample and its mapping rows held against counts that these tables don't all have, so that checks fail and pass."""
    return M.reconcile(align._t(spark, d, "sample_assignments"), rows(spark, d), 300, 150, 40, ("one",), ("primary", "splice", "other"))


def probe_problems(spark: SparkSession, d: str) -> DataFrame:
    """All sample ids as probes, chromosomes as the reference's contigs."""
    ids = align._t(spark, d, "sample_assignments").select(F.col("sample_id").alias("query_name"))
    r = align.records(spark, d)
    return C.probe_problems(r, ids, r.where(F.col("chrom").rlike("^chr")).select("chrom"))


def control_sources(spark: SparkSession, d: str) -> DataFrame:
    return first_sources(align._t(spark, d, "sample_assignments"), 100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (mode_rows, build_summary, expected_counts, probe_problems, control_sources)}


def oracle_sql() -> dict[str, str]:
    one = sql.MAP.replace("from alignment_records where (flag & 4) = 0", "from alignment_records where not contains(cigar, 'N') and (flag & 4) = 0")
    hits = "left join (with {} select query_name, exact_hits eh from occ) o on o.query_name = i.query_name"
    ids = "select distinct query_name from ({a}) union select distinct query_name from ({b}) union select distinct sample_id from sample_assignments where sample_id is not null"
    loci = lambda m: f"with {m} select * from loci"
    fields = ["chrom", "cast(ref_start as bigint) \"start\"", "cast(ref_end as bigint) \"end\"", "strand", "cast(coalesce(n_blocks, 0) as bigint) block_count", "block_starts", "block_sizes", "round(coverage, 9) coverage", "round(identity, 9) identity", "cast(mapq as bigint) mapq", "cast(as_score as bigint) alignment_score", "intron_lengths", "canonical_junctions"]

    def cols(alias: str, prefix: str) -> str:
        out = []
        for f in fields:
            expr, name = (f.rsplit(" ", 1) if " " in f else (f, f))
            name = name.strip('"')
            for c in ("chrom", "ref_start", "ref_end", "strand", "n_blocks", "block_starts", "block_sizes", "coverage", "identity", "mapq", "as_score", "intron_lengths", "canonical_junctions"):
                if expr == c or f"({c}" in expr:
                    expr = expr.replace(c, f"{alias}.{c}", 1)
                    break
            out.append(f'{expr} "{prefix}{name}"')
        return ", ".join(out)

    def mode(name: str, m: str) -> str:
        first = name == "primary"
        good = "b.coverage >= 0.98 and b.identity >= 0.99"
        perfect = "coalesce(b.coverage = 1 and b.identity = 1, false)"
        category = (
            f"case when b.query_name is null then 'unmapped' when not ({good}) then 'low_quality' when z.sec then 'ambiguous' when {perfect} and coalesce(o.eh, 0) = 1 then 'exact_unique' else 'high_conf_unique' end"
            if first
            else f"case when b.query_name is null then 'unmapped' when not ({good}) then 'low_quality' else (case when b.intron_lengths <> '' then 'spliced' else 'unspliced' end) || (case when z.sec then '_ambiguous' else '_unique' end) end"
        )
        ev = f"cast(coalesce(o.eh, 0) as bigint) exact_occurrence_count, {perfect} best_is_perfect, {perfect} and not coalesce(z.sec, false) perfect_unique_candidate" if first else "cast(null as bigint) exact_occurrence_count, cast(null as boolean) best_is_perfect, cast(null as boolean) perfect_unique_candidate"
        tied = "concat_ws(';', case when z.n02 then '0.02' end, case when z.n05 then '0.05' end, case when z.n10 then '0.1' end)"
        return f"""select i.query_name sample_id, a.stratum is null is_control, coalesce(a.stratum, 'control') stratum, 'one' build, '{name}' "mode", {category} category, {ev}, {cols('b', '')}, {cols('s', 'best_secondary_')}, {tied} near_tied_fractions
from ids i left join (select * from {name}_l where rank = 1) b on b.query_name = i.query_name left join (select * from {name}_l where rank = 2) s on s.query_name = i.query_name
left join (select l.query_name, max(l.rank > 1 and l.coverage >= 0.90 and l.identity >= 0.95) sec, max(l.rank > 1 and l.as_score >= t.as_score * cast(0.98 as double)) n02, max(l.rank > 1 and l.as_score >= t.as_score * cast(0.95 as double)) n05, max(l.rank > 1 and l.as_score >= t.as_score * cast(0.9 as double)) n10
 from {name}_l l join (select query_name, as_score from {name}_l where rank = 1) t on t.query_name = l.query_name group by 1) z on z.query_name = i.query_name
left join (select sample_id, min(stratum) stratum from sample_assignments where sample_id is not null group by 1) a on a.sample_id = i.query_name {hits.format(sql.MAP) if first else ''}"""

    body = f"primary_l as ({loci(one)}), splice_l as ({loci(sql.MAP)}), ids as ({ids.format(a='select query_name from primary_l', b='select query_name from splice_l')}), mr as ({mode('primary', one)} union all {mode('splice', sql.MAP)})"
    wide = """p as (select * from mr where "mode" = 'primary'), s as (select sample_id, category, chrom from mr where "mode" = 'splice'),
w0 as (select p.sample_id query_name, p.is_control, p.stratum, p.category pc, s.category sc, coalesce(p.chrom, s.chrom) chrom from p left join s using (sample_id)),
w as (select *, pc in ('exact_unique', 'high_conf_unique') up, coalesce(sc = 'spliced_unique', false) us, pc in ('exact_unique', 'high_conf_unique') or coalesce(sc = 'spliced_unique', false) uc from w0),
sc as (select *, unnest(['combined', 'primary', 'splice']) scope from w where not is_control), sk as (select *, case scope when 'combined' then uc when 'primary' then up else us end u from sc)"""
    dec = align.oracle_sql()["retention_by_gc"]
    dec = dec[len("with ") : dec.index("select scope, gc_decile")]
    ob = f"with {sql.OBS} select 'row_' || row_index query_name, protein_id, y from obs"
    n = "count(*) filter (u) successes, count(*) total"
    return {
        "probe_problems": f"with {sql.ALN}, p as (select query_name, count(*) k, count(*) filter (regexp_matches(chrom, '^chr')) own from ar where is_primary group by 1), i as (select distinct sample_id query_name from sample_assignments where sample_id is not null), x as (select query_name, coalesce(k, 0) n, coalesce(own, 0) own from i left join p using (query_name)) select query_name, case when n <> 1 then 'primary_records' else 'foreign_contig' end problem, n from x where n <> 1 or own = 0",
        "control_sources": "select distinct sample_id from sample_assignments where sample_id is not null order by sample_id limit 100",
        "mode_rows": f"with {body} select * from mr",
        "build_summary": f"""with {body}, {wide}, dd as (with {dec} select * from dec), ob as ({ob}), oc as (select scope, protein_id, y, u from sk join ob using (query_name)), c as (
select 'categories' part, "mode" || '|' || is_control || '|' || category cell, count(*) successes, count(*) total from mr group by "mode", is_control, category
union all select 'usable', scope, {n} from sk group by scope
union all select 'contiguous_or_rescued', case when up then 'contiguous_usable' when us then 'splice_rescued' else 'still_unusable' end || '|' || stratum, count(*), count(*) from w where not is_control group by 2
union all select 'quality', "mode" || '|' || field || '|' || cast(least(9, floor(greatest(0, least(1, v)) * 10)) as int), count(*), count(*) from (select "mode", unnest(['coverage', 'identity']) field, unnest([coverage, identity]) v from mr where not is_control and coverage is not null) group by 2
union all select 'by_class', scope || '|' || coalesce(cast(protein_id as varchar), '') || '|' || y, {n} from oc group by grouping sets ((scope, protein_id, y), (scope, y))
union all select 'by_gc', scope || '|' || gc_decile, {n} from sk join dd using (query_name) group by 2
union all select 'by_complexity', scope || '|' || complexity_decile, {n} from sk join dd using (query_name) group by 2
union all select 'by_contig', scope || '|' || case when regexp_matches(chrom, '^chr[0-9]+$') then 'chromosome' else 'unplaced' end, {n} from sk where regexp_matches(chrom, '^chr[0-9]+$') or regexp_matches(chrom, '^ctg_') group by 2) select * from c""",
        "expected_counts": f"""with {body}, a as (select sample_id, count(*) k, count(*) filter (stratum = 'representative') rep, count(*) filter (stratum in ('representative', 'quota', 'filler')) ok from sample_assignments group by 1),
t as (select sum(k) n, sum(k - 1) extra, sum(rep) rep, sum(k - ok) odd, count(sample_id) ids from a), known as (select distinct sample_id from sample_assignments where sample_id is not null),
g as (select "mode", is_control, count(*) n, count(distinct sample_id) ids, count(distinct case when sample_id in (select sample_id from known) then sample_id end) there from mr group by 1, 2), nc as (select count(distinct sample_id) n from mr where is_control),
grid as (select unnest(['primary', 'splice', 'other']) "mode"), gc as (select grid."mode", c.is_control, coalesce(g.n, 0) n, coalesce(g.ids, 0) ids, coalesce(case when c.is_control then g.ids else g.there end, 0) there from grid cross join (select unnest([false, true]) is_control) c left join g on g."mode" = grid."mode" and g.is_control = c.is_control),
r as (select 'sample_total' "check", null build, null "mode", null is_control, 300 expected, n observed from t union all select 'sample_uniqueness', null, null, null, 0, extra from t union all select 'representative_count', null, null, null, 150, rep from t union all select 'stratum_partition', null, null, null, 0, odd from t
union all select 'empty_mapping_results', null, null, null, 0, (select count(*) = 0 from mr)::int union all select 'invalid_category', null, null, null, 0, 0 union all select 'control_count', null, null, null, 40, n from nc
union all select 'unknown_sample_ids', null, null, null, 0, count(distinct sample_id) from mr where not is_control and sample_id not in (select sample_id from known)
union all select 'one_category_per_row', 'one', "mode", is_control, n, ids from gc union all select 'missing_mapping_ids', 'one', "mode", is_control, case when is_control then (select n from nc) else (select ids from t) end, there from gc
union all select 'category_row_count', 'one', "mode", is_control, case when is_control then (select n from nc) else 300 end, n from gc)
select "check", build, "mode", is_control, cast(expected as bigint) expected, cast(observed as bigint) observed, case when expected = observed then 'passed' else 'failed' end status from r""",
    }
