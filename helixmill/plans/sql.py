"""Common table expressions of the oracle SQL."""

REC = """rec as (select * exclude (rn_) from (select *, row_number() over (partition by row_index order by loaded_at nulls first, sequence nulls first, labels nulls first) rn_
 from tiny_coordinates_dataset where row_index is not null) where rn_ = 1)"""

WIN = (
    REC
    + r""", cell as (select row_index, coalesce(regexp_replace(sequence, '\s', '', 'g'), '') s from rec),
win as (select row_index, case when s = '' then '' when regexp_matches(s, '[01]') then
 coalesce(array_to_string(list_transform(range(0, length(s) // 4), lambda i: case substr(s, i * 4 + 1, 4) when '1000' then 'A' when '0100' then 'C' when '0010' then 'G' when '0001' then 'T' else 'N' end), ''), '')
 else regexp_replace(translate(upper(s), 'U', 'T'), '[^ACGT]', 'N', 'g') end seq from cell)"""
)

VAL = (
    REC
    + r""", bare as (select row_index, regexp_replace(labels, '(\(|:? |- |– )\s*(see note \d+|depth \d+; re-run|rep \d+, low depth|weak; rep \d+|call \d+\|\d+)\)?', ' ~ ', 'g') s from rec where labels is not null),
tok as (select row_index, regexp_extract_all(s, '[+\-−–]?([A-Za-z]{3,5}\d[A-Za-z]?|\d+(\.0+)?)', 0) x from bare),
tok1 as (select row_index, unnest(x) t, generate_subscripts(x, 1) k from tok),
tok2 as (select row_index, k, case when left(t, 1) in ('-', '−', '–') then -1 else 1 end sg, regexp_replace(regexp_replace(t, '^[+\-−–]', ''), '\.0+$', '') b from tok1),
val as (select row_index, cast(row_number() over (partition by row_index order by k) as int) pos, cast(sg * coalesce(p.protein_id, try_cast(b as int)) as int) v
 from tok2 left join (select upper(protein_name) nm, min(protein_id) protein_id from proteins group by 1) p on upper(b) = p.nm where coalesce(p.protein_id, try_cast(b as int)) is not null)"""
)

#: Label observations: in range, of one sign only in the record.
OBS = VAL + ", obs as (select row_index, abs(v) protein_id, max(case when v > 0 then 1 else 0 end) y from val where abs(v) between 1 and 122 group by 1, 2 having min(sign(v)) = max(sign(v)))"

ALN = """ar as (select min(ord) ord, query_name, flag, chrom, pos1 - 1 pos0, mapq, cigar, nm, as_score, case when (flag & 16) <> 0 then '-' else '+' end strand, (flag & 2304) = 0 is_primary
 from alignment_records where (flag & 4) = 0 and cigar <> '*' and chrom <> '*' group by query_name, flag, chrom, pos1, mapq, cigar, nm, as_score),
op0 as (select *, regexp_extract_all(cigar, '[0-9]+[A-Za-z=]') x from ar),
op1 as (select * exclude (x), unnest(x) t, generate_subscripts(x, 1) k from op0),
op2 as (select * exclude (t), cast(left(t, length(t) - 1) as int) n, right(t, 1) op from op1),
op3 as (select *, case when op in ('M','D','N','=','X') then n else 0 end rn, case when op in ('M','I','S','=','X','H') then n else 0 end qn, case when op = 'M' then n else 0 end mn, op in ('N','S','H') br from op2),
op4 as (select *, pos0 + sum(rn) over w - rn ref0, sum(qn) over w - qn read0, sum(qn) over p tl, max(op in ('=','X')) over p ext, sum(mn) over p all_m, sum(case when op in ('I','D') then n else 0 end) over p all_id,
 sum(mn) over w m_so, sum(case when br then 1 else 0 end) over w blk, last_value(case when op = 'N' then n end ignore nulls) over b last_n, last_value(case when op = 'N' then k end ignore nulls) over b last_nk, max(case when not br then k end) over b last_k
 from op3 window w as (partition by ord order by k rows unbounded preceding), p as (partition by ord), b as (partition by ord order by k rows between unbounded preceding and 1 preceding)),
op5 as (select *, least(greatest(coalesce(nm, 0) - all_id, 0), all_m) wrong from op4),
op6 as (select *, case when op = 'X' then n when op = 'M' and not ext then cast(round_even(m_so * wrong / cast(all_m as double), 0) - round_even((m_so - n) * wrong / cast(all_m as double), 0) as int) else 0 end xx from op5),
op7 as (select *, case when op = '=' then n when op = 'M' and not ext then n - xx else 0 end mm from op6),
blk0 as (select ord, blk, query_name, chrom, strand, is_primary, mapq, as_score, tl, min(ref0) ref_start, max(ref0 + rn) ref_end, min(read0) lo, max(read0 + qn) hi, sum(case when op in ('M','=','X','I') then n else 0 end) aligned,
 sum(mm) matches, sum(xx) mismatches, sum(case when op = 'I' then n else 0 end) insertions, sum(case when op = 'D' then n else 0 end) deletions, arg_min_null(case when last_nk > coalesce(last_k, 0) then last_n end, k) intron_before
 from op7 where not br group by all),
blk1 as (select *, case when strand = '+' then lo else tl - hi end t_start, case when strand = '+' then hi else tl - lo end t_end from blk0),
grp0 as (select *, case when lag(t_end) over w is null then 0 when t_start >= lag(t_end) over w - 5 and case when strand = '+' then ref_start >= lag(ref_end) over w - 5 else ref_end <= lag(ref_start) over w + 5 end then 0 else 1 end nw
 from blk1 window w as (partition by query_name, chrom, strand order by t_start, ord, blk)),
grp1 as (select *, cast(sum(nw) over (partition by query_name, chrom, strand order by t_start, ord, blk rows unbounded preceding) as int) grp from grp0),
loc0 as (select *, max(t_end) over (partition by query_name, chrom, strand, grp order by t_start, ord, blk rows between unbounded preceding and 1 preceding) pe,
 case when lag(ord) over (partition by query_name, chrom, strand, grp order by ref_start, t_start, ord, blk) = ord then intron_before end intron,
 min(ord) over (partition by query_name, chrom, strand) fo, max(tl) over (partition by query_name) longest from grp1),
loc1 as (select *, least(greatest(0, pe - t_start), t_end - t_start) ov from loc0),
loc2 as (select *, case when pe is null or ov = 0 then 1.0::double when t_end = t_start then 0.0::double else (t_end - t_start - ov) / cast(t_end - t_start as double) end part from loc1),
loc3 as (select query_name, chrom, strand, grp, fo, longest, count(*) n_blocks, min(ref_start) ref_start, max(ref_end) ref_end, cast(sum(round_even(aligned * part, 0)) as bigint) aligned, cast(sum(round_even(matches * part, 0)) as bigint) matches,
 cast(sum(round_even(mismatches * part, 0)) as bigint) mismatches, cast(sum(round_even(insertions * part, 0)) as bigint) insertions, cast(sum(round_even(deletions * part, 0)) as bigint) deletions, max(mapq) mapq, max(as_score) as_score,
 max(is_primary) is_primary, coalesce(string_agg(cast(intron as varchar), ';' order by ref_start, intron) filter (intron is not null), '') intron_lengths,
 string_agg(cast(ref_start as varchar), ';' order by ref_start, ref_end) block_starts, string_agg(cast(ref_end - ref_start as varchar), ';' order by ref_start, ref_end) block_sizes, repeat(';', greatest(0, cast(count(intron) as int) - 1)) canonical_junctions from loc2 group by all),
loc4 as (select *, case when matches + mismatches + insertions + deletions > 0 then matches / cast(matches + mismatches + insertions + deletions as double) else 0 end identity, case when longest > 0 then aligned / cast(longest as double) else 0 end coverage from loc3),
loci as (select *, cast(row_number() over (partition by query_name order by is_primary desc, as_score desc nulls last, coverage desc, identity desc, fo, grp) as int) rank from loc4)"""

MAP = (
    ALN
    + """, hit as (select distinct query_name, chrom, pos0 "start", pos0 + cast(left(cigar, length(cigar) - 1) as int) stop, strand from ar where regexp_matches(cigar, '^[0-9]+[M=]$') and coalesce(nm, 0) = 0),
occ as (select query_name, count(*) exact_hits from hit group by 1),
ids as (select distinct query_name from alignment_records where query_name is not null union select distinct sample_id from sample_assignments where sample_id is not null),
top as (select *, max(case when rank = 1 then as_score end) over (partition by query_name) best_as from loci),
per as (select query_name, max(case when rank = 1 then chrom end) chrom, max(case when rank = 1 then strand end) strand, max(case when rank = 1 then ref_start end) ref_start, max(case when rank = 1 then ref_end end) ref_end,
 max(case when rank = 1 then coverage end) coverage, max(case when rank = 1 then identity end) identity, max(case when rank = 1 then as_score end) as_score, max(case when rank = 1 then mapq end) mapq, max(case when rank = 1 then n_blocks end) n_blocks,
 max(case when rank = 1 then intron_lengths end) intron_lengths, max(rank > 1 and coverage >= 0.90 and identity >= 0.95) sec, count(*) n_loci,
 coalesce(max(rank > 1 and as_score >= best_as * cast(0.98 as double)), false) n02, coalesce(max(rank > 1 and as_score >= best_as * cast(0.95 as double)), false) n05, coalesce(max(rank > 1 and as_score >= best_as * cast(0.9 as double)), false) n10 from top group by 1),
map0 as (select ids.query_name, per.* exclude (query_name), coalesce(occ.exact_hits, 0) exact_hits from ids left join per using (query_name) left join occ using (query_name)),
map as (select *, case when n_loci is null then 'unmapped' when not (coverage >= 0.98 and identity >= 0.99) then 'low_quality' when sec then 'ambiguous' when coverage = 1 and identity = 1 and exact_hits = 1 then 'exact_unique' else 'high_conf_unique' end primary_category,
 case when n_loci is null then 'unmapped' when not (coverage >= 0.98 and identity >= 0.99) then 'low_quality' else (case when intron_lengths <> '' then 'spliced' else 'unspliced' end) || (case when sec then '_ambiguous' else '_unique' end) end splice_category,
 concat_ws(';', case when n02 then '0.02' end, case when n05 then '0.05' end, case when n10 then '0.1' end) near_tied from map0),
asg as (select sample_id query_name, min(stratum) stratum from sample_assignments where sample_id is not null group by 1),
mp as (select m.*, a.stratum, a.stratum is null is_control, primary_category in ('exact_unique', 'high_conf_unique') use_primary, splice_category = 'spliced_unique' use_splice, primary_category in ('exact_unique', 'high_conf_unique') or splice_category = 'spliced_unique' usable
 from map m left join asg a using (query_name))"""
)


def wilson(k: str, n: str) -> str:
    """point, lower and upper of the Wilson interval, rounded to 9 places."""
    p, nn = f"({k} / cast(nullif({n}, 0) as double))", f"cast({n} as double)"
    half = f"1.96 * sqrt({p} * (1 - {p}) / {nn} + 3.8416 / (4 * {nn} * {nn}))"
    mid, sc = f"({p} + 3.8416 / (2 * {nn}))", f"(1 + 3.8416 / {nn})"
    c = lambda x: f"cast(coalesce({x}, 0) as double)"
    return f"round({c(p)}, 9) point, round(greatest(0, {c(f'({mid} - {half}) / {sc}')}), 9) \"lower\", round(least(1, {c(f'({mid} + {half}) / {sc}')}), 9) \"upper\""
