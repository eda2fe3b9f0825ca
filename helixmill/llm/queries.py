"""The queries of the training-data problems, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.labels import first_delivery
from helixmill.functions.windows import windows
from helixmill.llm import abuse, frequency, mixing, neardup, overlap, sampling, spans, splits, tokenize
from helixmill.llm.records import newest_audit, record_values
from helixmill.plans import sql
from helixmill.session import materialize


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "tiny_coordinates_dataset")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_lengths(windows(_records(spark, d))).where("shared_nt > 0").select("row_index", "shared_nt")


def p1_shared_lengths(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_lengths(windows(_records(spark, d)))


def p1_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(windows(_records(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.short_classes(_records(spark, d), _t(spark, d, "proteins"), _t(spark, d, "dataset_audit"))


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw(_records(spark, d), _t(spark, d, "proteins"), _t(spark, d, "dataset_audit"))[0]


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw(_records(spark, d), _t(spark, d, "proteins"), _t(spark, d, "dataset_audit"))[1]


def p2_balance_ok(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_checks(_records(spark, d), _t(spark, d, "proteins"), _t(spark, d, "dataset_audit"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_groups(_records(spark, d), _t(spark, d, "proteins"), _t(spark, d, "split_targets"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(_records(spark, d), _t(spark, d, "proteins"), _t(spark, d, "split_targets"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(_records(spark, d), _t(spark, d, "proteins"), _t(spark, d, "split_targets"))


def p3_balance_ok(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_checks(_records(spark, d), _t(spark, d, "proteins"), _t(spark, d, "split_targets"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    values = materialize(record_values(r, _t(spark, d, "proteins")), "values")
    return frequency.marked_counts(values, first_delivery(r, "row_index", [], None).count())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).where("mark is not null").select(F.col("value").cast("int").alias("label_value"), "mark")


def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    known = newest_audit(_t(spark, d, "dataset_audit")).select("protein_id", "known_count")
    m = _marked(spark, d)
    return m.join(known, F.abs("value") == F.col("protein_id"), "left").select(F.col("value").cast("int").alias("label_value"), "n_occurrences", "n_records", "known_count", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    terms = materialize(frequency.document_terms(docs), "terms")
    return frequency.marked_counts(terms, docs.where("doc_id is not null").count(), key="doc_id").withColumnRenamed("value", "term").withColumnRenamed("n_records", "n_documents")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs(windows(_records(spark, d)))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(windows(_records(spark, d)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(_records(spark, d))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_records(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(_t(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.texts_of_ids(tokenize.token_ids(_t(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.capped_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p9_shares_ok(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_checks(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.content_scores(_t(spark, d, "documents")).where("is_abusive").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.content_scores(_t(spark, d, "documents"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(_t(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_shared_lengths, p1_spans, p2_found, p2_sample, p2_report, p2_balance_ok, p3_found, p3_splits, p3_report, p3_balance_ok, p4_found, p4_frequencies, p4_terms, p6_found, p6_groups]
    own += [p7_found, p7_report, p8_ids, p8_round_trip, p9_found, p9_mixture, p9_report, p9_shares_ok, p10_found, p10_scores, p10_rates]
    return {f.__name__: f for f in own}


_AUDIT = """aud as (select * from dataset_audit where audited_at is not null and protein_id is not null and audit_id is not null),
newest as (select audit_id from aud group by 1 order by min(audited_at) desc, audit_id desc limit 1),
au as (select protein_id, coalesce(positive_count, 0) p, coalesce(negative_count, 0) n, known_count from aud where audit_id = (select audit_id from newest)
 qualify row_number() over (partition by protein_id order by audited_at desc, positive_count desc nulls last, negative_count desc nulls last, known_count desc nulls last) = 1)"""

_SETS = (
    sql.WIN
    + """, km as (select distinct row_index, substr(seq, i, 8) k from (select row_index, seq, unnest(range(1, length(seq) - 6)) i from win where length(seq) >= 8) where not contains(substr(seq, i, 8), 'N')),
sz as (select row_index, count(*) n from km group by 1)"""
)


def oracle_sql() -> dict[str, str]:
    split = "case when lower(trim(split_name)) in ('train', 'training') then 0 when lower(trim(split_name)) in ('validation', 'valid', 'val', 'test') then 1 end"
    near = "select a, b from {} join sz x on x.row_index = a join sz y on y.row_index = b where c >= 0.6 * (x.n + y.n - c) - 1e-9"
    marks = f"with {sql.VAL}, f as (select v, count(*) occ, count(distinct row_index) rec from val group by 1), n as (select count(*) n from rec), m as (select v, occ, rec, case when rec <= 2 then 'rare' when rec > cast(0.05 as double) * n then 'common' end mark from f, n)"
    tie = r"regexp_replace(lower(regexp_replace(transcript_id, '^\s+|\s+$', '', 'g')), '\s*\.\d+$', '')"
    hit = f"{sql.WIN}, st as (select row_index, i, substr(seq, i, 150) s from (select row_index, seq, unnest(range(1, length(seq) - 148)) i from win where length(seq) >= 150) where not contains(substr(seq, i, 150), 'N')), sh as (select s from st group by 1 having count(distinct row_index) > 1), hit as (select row_index, i, lag(i) over (partition by row_index order by i) p from st where s in (select s from sh))"
    span = f"{hit}, isl as (select *, sum(case when p is null or i > p + 150 then 1 else 0 end) over (partition by row_index order by i) g from hit), span as (select row_index, cast(min(i) - 1 as int) \"start\", cast(max(i) + 149 as int) stop from isl group by row_index, g)"
    over = f"sp as (select row_index, {split} s from rec), l as (select km.row_index, k from km join sp using (row_index) where s = 0), r as (select km.row_index, k, reverse(translate(k, 'ACGT', 'TGCA')) q from km join sp using (row_index) where s = 1), c as (select l.row_index a, r.row_index b, count(*) c from l join r on l.k = r.k group by 1, 2 union all select l.row_index, r.row_index, count(*) from l join r on l.k = r.q group by 1, 2), n as ({near.format('c')})"
    name = "case when lower(trim(split_name)) in ('validation', 'valid', 'val') then 'validation' when lower(trim(split_name)) = 'test' then 'test' end"
    return {
        "p1_spans": f"with {span} select * from span",
        "p1_shared_lengths": f"with {span}, x as (select row_index, count(*) k, sum(stop - \"start\") n from span group by 1) select row_index, cast(length(seq) as int) n_bases, cast(coalesce(k, 0) as int) n_spans, cast(coalesce(n, 0) as int) shared_nt, case when length(seq) > 0 then coalesce(n, 0) / cast(length(seq) as double) end shared_share from win left join x using (row_index)",
        "p6_groups": f"with recursive {_SETS}, c as (select x.row_index a, y.row_index b, count(*) c from km x join km y on x.k = y.k and x.row_index < y.row_index group by 1, 2), n as ({near.format('c')}), e as materialized (select a, b from n union select b, a from n), sg as (select row_index, md5(string_agg(k, '' order by k)) h from km group by 1), cl as (select row_index, min(row_index) over (partition by h) class_row_index from sg), reach as (select row_index a, row_index b from sz union select r.a, e.b from reach r join e on r.b = e.a), g as (select a row_index, min(b) group_row_index from reach group by 1), dg as (select a row_index, count(*) k from e group by 1) select row_index, class_row_index, group_row_index, cast(coalesce(k, 0) as int) n_links from cl join g using (row_index) left join dg using (row_index)",
        "p7_report": f"with {_SETS}, {over}, h as (select distinct b row_index, 1 hit from n), a as (select row_index, {name} split_name, nullif(lower(trim(source)), '') source from rec) select split_name, source, count(*) n_records, cast(coalesce(sum(hit), 0) as bigint) n_overlapping from a left join h using (row_index) where split_name is not null group by 1, 2",
        "p1_found": f"with {hit} select row_index, cast(sum(least(150, i - coalesce(p, -150))) as int) shared_nt from hit group by 1",
        "p2_found": f"with {sql.VAL}, {_AUDIT}, t as (select sum(p + n) t from au), nn as (select count(*) // 5 n from rec), cl as (select protein_id l, p c from au union all select -protein_id, n from au), h as (select v, count(distinct row_index) k from val group by 1) select l label_value from cl left join h on l = v, t, nn where coalesce(k, 0) < greatest(1, (nn.n * c) // t)",
        "p3_found": f"""with recursive {sql.WIN}, kk as materialized (select row_index, least(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) k from win where seq <> ''),
tt as (select row_index, case when t not in ('', '-', 'na', 'n/a', 'unknown', 'none', 'null') then t end t from (select row_index, {tie} t from rec)),
star as materialized (select row_index a, min(row_index) over (partition by k) b from kk union select row_index, min(row_index) over (partition by t) from tt where t is not null),
ed as materialized (select a, b from star where a <> b union select b, a from star where a <> b), reach as (select row_index a, row_index b from tt union select r.a, e.b from reach r join ed e on r.b = e.a),
mem as (select a row_index, min(b) group_row_index from reach group by 1) select row_index, group_row_index from mem where group_row_index in (select group_row_index from mem group by 1 having count(*) > 1)""",
        "p4_found": f"{marks} select v label_value, mark from m where mark is not null",
        "p4_frequencies": f"{marks[:-1]}), {_AUDIT} select v label_value, occ n_occurrences, rec n_records, known_count, mark from m left join au on abs(v) = protein_id",
        "p4_terms": "with w as (select doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) term from documents), c as (select term, count(*) n_occurrences, count(distinct doc_id) n_documents from w group by 1), n as (select count(*) n from documents) select term, n_occurrences, n_documents, case when n_documents <= 2 then 'rare' when n_documents > cast(0.05 as double) * n then 'common' end mark from c, n",
        "p6_found": f"with {_SETS}, c as (select x.row_index a, y.row_index b, count(*) c from km x join km y on x.k = y.k and x.row_index < y.row_index group by 1, 2) {near.format('c').replace('select a, b', 'select a row_index_a, b row_index_b')}",
        "p2_balance_ok": "select true as converged, true as floors_ok, true as targets_ok",
        "p3_balance_ok": "select split_name, true as shares_ok, true as minima_ok, true as classes_ok from split_targets",
        "p9_shares_ok": "select source, true as share_ok, true as repeats_ok from mix_targets where source is not null and target_weight is not null",
        "p8_round_trip": "select doc_id, coalesce(text, '') as text from documents",
        "p7_found": f"with {_SETS}, {over} select distinct least(a, b) row_index_a, greatest(a, b) row_index_b from n",
    }
