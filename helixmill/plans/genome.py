"""Queries on contigs, partitions and formats. The contigs are the suppliers as an assembly report, and the windows as sequences."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import names as N
from helixmill.functions.sequence import window_text
from helixmill.operators import alignment as A
from helixmill.operators import partitions as P
from helixmill.operators import reference as R
from helixmill.operators.audit import label_observations
from helixmill.plans import sql
from helixmill.plans.packed import protein_ids
from helixmill.session import materialize, shared_dir
from helixmill.sources import readers, sinks


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "tiny_coordinates_dataset")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return materialize(window_text(_records(spark, d)), "texts")


def report(spark: SparkSession, d: str) -> DataFrame:
    s, n = _t(spark, d, "supplier"), _t(spark, d, "nation")
    k = F.col("s_suppkey")
    x = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)  # 25 rows
    role = F.when(k % 7 == 0, "alt-scaffold").when(k % 5 == 0, "unlocalized-scaffold").when(k % 3 == 0, "Unplaced-Scaffold").otherwise("assembled-molecule")
    unit = F.when(k % 11 == 0, "non-nuclear").when(k % 13 == 0, "ALT_REF_LOCI_1").otherwise("Primary Assembly")
    return x.select(F.col("s_name").alias("sequence_name"), role.alias("role"), F.col("n_name").alias("molecule"), F.when(k % 4 == 0, "na").otherwise(F.concat(F.lit("GB"), k.cast("string"))).alias("genbank"), F.when(k % 6 == 0, " ").otherwise(F.concat(F.lit("NC_"), k.cast("string"))).alias("refseq"), unit.alias("unit"), (k * 1000 + 1).alias("length"))


def contig_policy(spark: SparkSession, d: str) -> DataFrame:
    return R.apply_policy(report(spark, d)).select("sequence_name", "category", "accession", "raw_accession", "reason", "length")


def contig_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Excluded contigs in the order of category, name and accession."""
    return contig_policy(spark, d).where("reason is not null").orderBy("category", "sequence_name", "accession")


def policy_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.policy_counts(R.apply_policy(report(spark, d)))


def largest_contig(spark: SparkSession, d: str) -> DataFrame:
    return R.largest_contig(R.apply_policy(report(spark, d)))


def contig_summaries(spark: SparkSession, d: str) -> DataFrame:
    c = window_text(_records(spark, d)).select(F.col("row_index").cast("string").alias("id"), "seq")
    return R.contig_summary(c)


def contig_length_problems(spark: SparkSession, d: str) -> DataFrame:
    """The windows' lengths against 500."""
    w = window_text(_records(spark, d)).select("row_index", F.length("seq").alias("length"))
    return R.length_problems(w.select(F.col("row_index").alias("id"), "length"), w.select(F.col("row_index").alias("id"), F.lit(500).alias("length")))


def junction_motifs(spark: SparkSession, d: str) -> DataFrame:
    """Motifs at bases 100 to 400 of each window as if it were an intron, on the strand of the row's parity."""
    w = window_text(_records(spark, d)).withColumn("strand", F.when(F.col("row_index") % 2 == 0, "+").otherwise("-"))
    donor, acceptor, ok = R.junction_motif(F.substring("seq", 101, 2), F.substring("seq", 399, 2), F.col("strand"))
    return w.select("strand", donor.alias("donor"), acceptor.alias("acceptor"), ok.alias("canonical")).groupBy("strand", "donor", "acceptor", "canonical").agg(F.count("*").alias("n"))


def clean_runs(spark: SparkSession, d: str) -> DataFrame:
    return R.clean_runs(window_text(_records(spark, d)).select(F.col("row_index").cast("string").alias("id"), "seq"))


def probe_windows(spark: SparkSession, d: str) -> DataFrame:
    return R.probe_windows(window_text(_records(spark, d)).select(F.col("row_index").cast("string").alias("id"), "seq"), 200, 200)


def indexed_access(spark: SparkSession, d: str) -> DataFrame:
    """Spans across chunk borders of every window, by the chunked table."""
    w = _windows(spark, d).select(F.col("row_index").cast("string").alias("id"), "seq")
    want = w.select("id", F.lit(95).cast("long").alias("start"), F.lit(305).cast("long").alias("stop"))
    return readers.fetch(readers.chunked(w, 100), want, 100)


def exact_search(spark: SparkSession, d: str) -> DataFrame:
    """Every readable window of 32 bases or more in all windows, on both strands."""
    w = _windows(spark, d)
    p = w.where("length(seq) >= 32 and not contains(seq, 'N')").select(F.concat(F.lit("row_"), F.col("row_index").cast("string")).alias("name"), "seq")
    return R.exact_search(p, w.select(F.col("row_index").cast("string").alias("id"), "seq"))


def bed_problems(spark: SparkSession, d: str) -> DataFrame:
    """Perfect alignments as BED lines, held against chromosome 1 of 100 Mb; names of reverse hits count as unknown."""
    r = A.mapped_records(_t(spark, d, "alignment_records"))
    line = F.concat_ws("\t", "chrom", F.col("pos0").cast("string"), (F.col("pos0") + 500).cast("string"), "query_name", F.coalesce(F.col("as_score").cast("string"), F.lit(".")), "strand")
    return R.bed_problems(r.select(line.alias("line")).distinct(), "chr1", 100_000_000, r.where("strand = '+'").select(F.col("query_name").alias("name")).distinct()).groupBy("problem").agg(F.count("*").alias("n"))


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return P.duplicate_groups(window_text(_records(spark, d)))


def _members(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower(F.trim("transcript_id"))
    t = F.regexp_replace(t, r"\.[0-9]+$", "")
    x = _records(spark, d).where("row_index is not null").groupBy("row_index").agg(F.min(F.when(~t.isin("", "-", "na", "n/a", "unknown", "none", "null"), t)).alias("transcript"))
    return materialize(P.group_components(_windows(spark, d), x), "members")


def group_components(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d)


def component_ids(spark: SparkSession, d: str) -> DataFrame:
    return P.component_ids(_members(spark, d))


def component_gate(spark: SparkSession, d: str) -> DataFrame:
    return P.component_gate(_members(spark, d))


def partition_assignment(spark: SparkSession, d: str) -> DataFrame:
    return P.assign(_members(spark, d))


def fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Records of five folds of whole components."""
    return P.folds(_members(spark, d)).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("component").alias("n_components"))


def total_bases(spark: SparkSession, d: str) -> DataFrame:
    c = window_text(_records(spark, d))
    return c.agg(F.count("*").alias("n_contigs"), F.sum(F.length("seq")).alias("bases"))


def partition_balance(spark: SparkSession, d: str) -> DataFrame:
    o = label_observations(_records(spark, d), protein_ids(_t(spark, d, "proteins")))
    return P.balance(P.assign(_members(spark, d)), o)


def cross_partition_audit(spark: SparkSession, d: str) -> DataFrame:
    """Ties across partitions: none of equal windows; of the ties planted between each record and the next all whose ends lie apart."""
    w = _windows(spark, d)
    e = P.duplicate_groups(w).select(F.col("row_index").alias("a"), F.col("group_row_index").alias("b"))
    return P.crossing(P.assign(_members(spark, d)), e.unionByName(w.select(F.col("row_index").alias("a"), (F.col("row_index") + 1).alias("b"))))


def matched_negatives(spark: SparkSession, d: str) -> DataFrame:
    o = label_observations(_records(spark, d), protein_ids(_t(spark, d, "proteins")))
    return P.matched_negatives(window_text(_records(spark, d)), o)


def baseline_scores(spark: SparkSession, d: str) -> DataFrame:
    """Of the protein with the most known records each baseline's area by split, over all its records."""
    from functools import reduce

    from helixmill.operators.evaluation import auroc

    o = materialize(label_observations(_records(spark, d), protein_ids(_t(spark, d, "proteins"))), "observations")
    w, a = _windows(spark, d), materialize(P.assign(_members(spark, d)), "assigned")
    protein = o.groupBy("protein_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "protein_id").first().protein_id
    parts = [P.baseline(w, o, a, protein, kind).withColumn("kind", F.lit(kind)) for kind in P.BASELINES]
    return auroc(reduce(DataFrame.unionByName, parts), ["kind", "split_name"]).withColumn("protein_id", F.lit(protein))


def listing_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths made of the events' types and ids, normalized."""
    e = _t(spark, d, "events")
    k = F.col("event_id") % 6
    p = F.concat(F.when(k == 0, "./").when(k == 1, "/").when(k == 2, "a/../").when(k == 3, "a//./").when(k == 4, "b\\").otherwise("c/"), F.col("event_type"))
    return e.select(p.alias("p")).groupBy(N.listing_path(F.col("p")).alias("path"), N.listing_path_problem(F.col("p")).alias("problem")).agg(F.count("*").alias("n"))


def _fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/helixmill/{what}-{uuid.uuid4().hex}"


def sam_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All alignment records written as SAM lines and read again: mapped ones without ord."""
    path = _fresh(spark, "sam")
    sinks.write_sam(_t(spark, d, "alignment_records"), path)
    return readers.sam(spark, path).drop("ord")


def bed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _fresh(spark, "bed")
    h = A.perfect_hits(A.mapped_records(_t(spark, d, "alignment_records")))
    sinks.write_bed(h.select(F.col("query_name").alias("name"), "chrom", "start", "stop", "strand"), path)
    return readers.bed(spark, path)


def fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _fresh(spark, "fasta")
    sinks.write_fasta(window_text(_records(spark, d)).where("seq <> ''").select(F.concat(F.lit("row_"), F.col("row_index").cast("string"), F.lit(" window")).alias("id"), "seq"), path)
    return readers.fasta(spark, path)


def sample_tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _fresh(spark, "tsv")
    s = _t(spark, d, "sample_assignments").select("sample_id", "row_index", "stratum", F.nullif("labels", F.lit("")).alias("labels")).distinct()
    sinks.write_tsv(s, path, compress=True)
    return readers.mapping_tsv(spark, path, s.schema)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [contig_policy, contig_exclusions, policy_counts, largest_contig, contig_summaries, contig_length_problems, junction_motifs, clean_runs, probe_windows, indexed_access, exact_search, bed_problems, duplicate_groups, group_components]
    own += [component_ids, component_gate, partition_assignment, fold_sizes, total_bases, partition_balance, cross_partition_audit, matched_negatives, baseline_scores, listing_paths, sam_round_trip, bed_round_trip, fasta_round_trip, sample_tsv_round_trip]
    return {f.__name__: f for f in own}


POL = """rp as (select s_name sequence_name, s_suppkey k, case when s_suppkey % 7 = 0 then 'alt-scaffold' when s_suppkey % 5 = 0 then 'unlocalized-scaffold' when s_suppkey % 3 = 0 then 'unplaced-scaffold' else 'assembled-molecule' end role,
 case when s_suppkey % 4 <> 0 then 'GB' || s_suppkey end genbank, case when s_suppkey % 6 <> 0 then 'NC_' || s_suppkey end refseq, case when s_suppkey % 11 = 0 then 'non-nuclear' when s_suppkey % 13 = 0 then 'ALT_REF_LOCI_1' else 'Primary Assembly' end unit, s_suppkey * 1000 + 1 length from supplier join nation on s_nationkey = n_nationkey),
po as (select *, case when unit = 'Primary Assembly' then case role when 'assembled-molecule' then 'chromosome' when 'unlocalized-scaffold' then 'unlocalized' when 'unplaced-scaffold' then 'unplaced' end when unit = 'non-nuclear' and role = 'assembled-molecule' then 'mitochondrion' end category, coalesce(genbank, refseq) accession, coalesce(refseq, genbank) raw_accession from rp),
pol as (select sequence_name, category, accession, raw_accession, case when category is null then 'outside_policy' when accession is null then 'source_namespace_unrepresented' end reason, length from po)"""

_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_COMP = (
    sql.WIN
    + r""", kk as materialized (select row_index, least(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) k from win where seq <> ''),
tt as (select row_index, min(case when t not in ('', '-', 'na', 'n/a', 'unknown', 'none', 'null') then t end) t from (select row_index, regexp_replace(lower(trim(transcript_id)), '\.[0-9]+$', '') t from tiny_coordinates_dataset where row_index is not null) group by 1),
star as materialized (select row_index a, min(row_index) over (partition by k) b from kk union select row_index, min(row_index) over (partition by t) from tt where t is not null),
ed as materialized (select a, b from star where a <> b union select b, a from star where a <> b),
reach as (select row_index a, row_index b from tt union select r.a, e.b from reach r join ed e on r.b = e.a),
mem as (select a row_index, min(b) component from reach group by 1)"""
).replace("rec as (", "recursive rec as (", 1)


def oracle_sql() -> dict[str, str]:
    win = sql.WIN
    m = f"with {_COMP} "
    sid = "'row_' || row_index"
    cut = f"case when mid < total * cast({0.70!r} as double) then 'train' when mid < total * cast({0.70 + 0.15!r} as double) then 'validation' else 'test' end"
    asg = f", so as (select component, count(*) n, substr(sha256('20260925' || chr(31) || component), 1, 16) h from mem group by 1), oo as (select component, sum(n) over (order by h, component) - n / 2.0::double mid, cast(sum(n) over () as double) total from so), asg as (select mem.row_index, mem.component, {cut} split_name from mem join oo using (component))"
    return {
        "contig_policy": f"with {POL} select * from pol",
        "contig_exclusions": f"with {POL} select * from pol where reason is not null order by category nulls first, sequence_name, accession",
        "policy_counts": f"with {POL} select category, reason, count(*) n, cast(sum(length) as bigint) bases from pol group by 1, 2",
        "largest_contig": f"with {POL} select accession, length from pol where reason is null order by length desc, accession limit 1",
        "contig_summaries": f"with {win} select cast(row_index as varchar) id, cast(length(seq) as int) length, cast(length(regexp_replace(seq, '[^ACGT]', '', 'g')) as int) \"upper\", 0 \"lower\", cast(length(regexp_replace(seq, '[ACGT]', '', 'g')) as int) other, 'unmasked' masking from win",
        "total_bases": f"with {win} select count(*) n_contigs, cast(sum(length(seq)) as bigint) bases from win",
        "contig_length_problems": f"with {win} select row_index id, case when length(seq) = 0 then 'not_positive' else 'length' end problem from win where length(seq) <> 500",
        "junction_motifs": f"with {win}, j as (select case when row_index % 2 = 0 then '+' else '-' end strand, substr(seq, 101, 2) a, substr(seq, 399, 2) b from win), k as (select strand, case when strand = '-' then {_RC.format('b')} else a end donor, case when strand = '-' then {_RC.format('a')} else b end acceptor from j) select strand, donor, acceptor, case when length(donor) = 2 and length(acceptor) = 2 then donor = 'GT' and acceptor = 'AG' end canonical, count(*) n from k group by 1, 2, 3, 4",
        "clean_runs": f"with {win}, c as (select row_index, unnest(range(1, length(seq) + 1)) i, seq from win), o as (select row_index, i, i - row_number() over (partition by row_index order by i) g from c where substr(seq, i, 1) <> 'N') select cast(row_index as varchar) id, min(i) - 1 \"start\", count(*) length from o group by row_index, g",
        "probe_windows": f"with {win}, h as (select row_index, seq, cast(cast(('0x' || substr(sha256(cast(row_index as varchar) || chr(31) || length(seq) || chr(31) || 'probe_window'), 1, 16)) as uhugeint) % 200 as bigint) skip from win), s as (select row_index, skip, i - 1 st, row_number() over (partition by row_index order by i) - 1 nth from (select row_index, skip, seq, unnest(range(1, length(seq) - 198)) i from h where length(seq) >= 200) where not contains(substr(seq, i, 200), 'N')) select cast(row_index as varchar) id, coalesce(max(st) filter (nth = skip), min(st)) \"start\", coalesce(max(st) filter (nth = skip), min(st)) + 200 stop from s group by row_index",
        "indexed_access": f"with {win} select cast(row_index as varchar) id, cast(95 as bigint) \"start\", cast(305 as bigint) stop, case when length(seq) >= 305 then substr(seq, 96, 210) else '' end bases from win",
        "exact_search": f"with {win}, p as (select {sid} name, seq p from win where length(seq) >= 32 and not contains(seq, 'N')), b as (select name, p, left(p, 32) k, '+' strand from p union all select name, {_RC.format('p')}, left({_RC.format('p')}, 32), '-' from p), c as (select row_index, i - 1 st, substr(seq, i, 32) k, seq from (select row_index, seq, unnest(range(1, length(seq) - 30)) i from win where length(seq) >= 32)) select distinct name, cast(row_index as varchar) chrom, st \"start\", st + length(p) stop, strand from b join c using (k) where substr(seq, st + 1, length(p)) = p",
        "bed_problems": f"with {sql.ALN}, l as (select distinct chrom, pos0 s, pos0 + 500 e, query_name, coalesce(cast(as_score as varchar), '.') sc, strand from ar), kn as (select distinct query_name from ar where strand = '+'), n as (select *, row_number() over (partition by query_name, s, e, strand) nth from l where chrom = 'chr1'), pr as (select unnest([case when query_name not in (select query_name from kn) then 'unknown_pattern' end, case when not (s >= 0 and s < e and e <= 100000000) then 'bounds' end, case when sc = '.' then 'score_not_whole' end, case when sc <> '.' and cast(nullif(sc, '.') as int) < 0 then 'score_negative' end, case when nth > 1 then 'repeated' end]) problem from n union all select 'contig' from l where chrom <> 'chr1') select problem, count(*) n from pr where problem is not null group by 1",
        "duplicate_groups": f"with {win}, k as (select row_index, least(seq, {_RC.format('seq')}) k from win where seq <> ''), g as (select k, min(row_index) group_row_index, count(*) n from k group by 1 having count(*) > 1) select row_index, group_row_index, n from k join g using (k)",
        "group_components": m + "select row_index, component from mem",
        "component_ids": m + f", pt as (select component, substr(sha256({sid}), 1, 2) part, count(*) k, sha256(string_agg({sid}, ',' order by {sid})) d from mem group by 1, 2) select component, cast(sum(k) as bigint) n, sha256(string_agg(part || ':' || d, ',' order by part || ':' || d)) component_id from pt group by 1",
        "partition_assignment": m + asg + " select row_index, component, split_name from asg",
        "fold_sizes": m + asg.replace(cut, "cast(floor(least(4, mid / total * 5)) as int)").replace("split_name", "fold") + " select fold, count(*) n, count(distinct component) n_components from asg group by 1",
        "partition_balance": m + asg + f", o as (with {sql.OBS} select * from obs), b as (select split_name, protein_id, y, count(*) n from asg join o using (row_index) group by 1, 2, 3), c as (select *, n / cast(sum(n) over (partition by protein_id, y) as double) share from b) select split_name, protein_id, y, n, share, abs(share - case split_name when 'train' then 0.70::double else 0.15::double end) > 0.03::double off_share, split_name <> 'train' and n < 30 below_minimum from c",
        "component_gate": m + ", s as (select component, count(*) n from mem group by 1), t as (select n from s order by n desc, component limit 20) select (select count(*) from mem) n_records, (select max(n) from t) / cast((select count(*) from mem) as double) largest_share, (select sum(n) from t) / cast((select count(*) from mem) as double) top20_share, (select max(n) from t) <= 0.05 * (select count(*) from mem) and (select sum(n) from t) <= 0.20 * (select count(*) from mem) passed",
        "cross_partition_audit": m + asg + " select x.row_index a, y.row_index b, x.split_name split_a, y.split_name split_b from asg x join asg y on y.row_index = x.row_index + 1 where x.split_name <> y.split_name",
        "matched_negatives": f"with {win}, {sql.OBS[len(sql.REC) + 2:]}, x as (select row_index, protein_id, y, cast(least(9, floor(case when length(seq) = 0 then 0.0::double else length(regexp_replace(seq, '[^GC]', '', 'g')) / cast(length(seq) as double) end * 10)) as int) gc_decile from win join obs using (row_index)), r as (select *, row_number() over (partition by protein_id, gc_decile, y order by sha256('20260925:' || row_index), row_index) r from x) select a.protein_id, a.gc_decile, a.row_index positive, b.row_index negative from r a join r b on a.protein_id = b.protein_id and a.gc_decile = b.gc_decile and a.r = b.r and a.y = 1 and b.y = 0",
        "listing_paths": "with e as (select event_id % 6 k, event_type t from events) select case k when 0 then t when 3 then 'a/' || t when 5 then 'c/' || t end path, case k when 1 then 'absolute' when 2 then 'parent' when 4 then 'backslash' end problem, count(*) n from e group by 1, 2",
        "sam_round_trip": "select query_name, flag, chrom, pos1, mapq, cigar, nm, as_score from alignment_records where (flag & 4) = 0 and chrom <> '*' and cigar <> '*'",
        "bed_round_trip": f"with {sql.MAP} select query_name name, chrom, \"start\", stop, strand from hit",
        "fasta_round_trip": f"with {win} select {sid} id, 'window' description, seq from win where seq <> ''",
        "sample_tsv_round_trip": "select distinct sample_id, row_index, stratum, nullif(labels, '') labels from sample_assignments",
    }
