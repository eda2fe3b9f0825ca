"""From alignment records to candidate loci and terminal categories, as one relational plan without Python.

All positions are 0-based and half-open. A record's template coordinates run along the query as given, so those of reverse
records are turned. Every step is a window or an aggregation by record or by (query, chromosome, strand).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import names

TOLERANCE = 5
#: Least coverage and identity of a best locus, then of a plausible second one.
BEST = (0.98, 0.99)
SECOND = (0.90, 0.95)
FRACTIONS = (0.02, 0.05, 0.10)
_BREAKS = ("N", "S", "H")


def mapped_records(sam: DataFrame) -> DataFrame:
    """Mapped records once each, the first ord of repeated ones, with pos0, strand and is_primary."""
    m = sam.where(~names.flag_set(F.col("flag"), names.UNMAPPED) & (F.col("chrom") != "*") & (F.col("cigar") != "*"))
    once = m.groupBy("query_name", "flag", "chrom", "pos1", "mapq", "cigar", "nm", "as_score").agg(F.min("ord").alias("ord"))
    return once.select("ord", "query_name", "flag", "chrom", (F.col("pos1") - 1).alias("pos0"), "mapq", "cigar", "nm", "as_score", F.when(names.flag_set(F.col("flag"), names.REVERSE), "-").otherwise("+").alias("strand"), names.is_primary(F.col("flag")).alias("is_primary"))


def cigar_problem(cigar: Column) -> Column:
    """`malformed` or `unsupported`, or null."""
    return F.when(~cigar.rlike(r"^([0-9]+[A-Za-z=])*$") & (cigar != "*"), "malformed").when(cigar.rlike("[^0-9MIDNSHX=*]"), "unsupported")


def cigar_ops(records: DataFrame) -> DataFrame:
    """records with a row per operation: k from 1, n, op."""
    ops = F.regexp_extract_all("cigar", F.lit("([0-9]+[A-Za-z=])"), F.lit(1))
    x = records.select("*", F.posexplode(ops).alias("k0_", "t_"))
    return x.select(*records.columns, (F.col("k0_") + 1).alias("k"), F.expr("cast(left(t_, length(t_) - 1) as int)").alias("n"), F.right("t_", F.lit(1)).alias("op"))


def aligned_blocks(records: DataFrame) -> DataFrame:
    """Blocks of each record, parted by N, S and H: (ord, block, query_name, chrom, strand, is_primary, mapq, as_score, template_length,
    ref_start, ref_end, t_start, t_end, aligned, matches, mismatches, insertions, deletions, intron_before)."""
    o = cigar_ops(records)
    own, so_far = Window.partitionBy("ord"), Window.partitionBy("ord").orderBy("k")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    op, n = F.col("op"), F.col("n")
    num = lambda *kinds: F.when(op.isin(*kinds), n).otherwise(0)
    breaks = op.isin(*_BREAKS)
    o = o.select(
        "*",
        (F.sum(num("M", "D", "N", "=", "X")).over(so_far) - num("M", "D", "N", "=", "X") + F.col("pos0")).alias("ref0"),
        (F.sum(num("M", "I", "S", "=", "X", "H")).over(so_far) - num("M", "I", "S", "=", "X", "H")).alias("read0"),
        F.sum(num("M", "I", "S", "=", "X", "H")).over(own).alias("template_length"),
        F.max(op.isin("=", "X")).over(own).alias("extended"),
        F.sum(num("M")).over(own).alias("all_m"),
        F.sum(num("I", "D")).over(own).alias("all_id"),
        F.sum(num("M")).over(so_far).alias("m_so_far"),
        F.sum(breaks.cast("int")).over(so_far).alias("block"),
        F.last(F.when(op == "N", n), ignorenulls=True).over(before).alias("last_n"),
        F.last(F.when(op == "N", F.col("k")), ignorenulls=True).over(before).alias("last_n_k"),
        F.max(F.when(~breaks, F.col("k"))).over(before).alias("last_k"),
    )
    wrong = F.least(F.greatest(F.coalesce("nm", F.lit(0)) - F.col("all_id"), F.lit(0)), F.col("all_m"))
    upto = lambda m: F.bround(m * wrong / F.col("all_m")).cast("int")
    plain = F.when((op == "M") & ~F.col("extended"), upto(F.col("m_so_far")) - upto(F.col("m_so_far") - n)).otherwise(0)
    o = o.withColumn("x_", F.when(op == "X", n).otherwise(plain)).withColumn("m_", F.when(op == "=", n).when((op == "M") & ~F.col("extended"), n - F.col("x_")).otherwise(0))
    keys = ["ord", "block", "query_name", "chrom", "strand", "is_primary", "mapq", "as_score", "template_length"]
    b = o.where(~breaks).groupBy(*keys).agg(
        F.min("ref0").alias("ref_start"),
        F.max(F.col("ref0") + num("M", "D", "=", "X")).alias("ref_end"),
        F.min("read0").alias("lo"),
        F.max(F.col("read0") + num("M", "I", "=", "X")).alias("hi"),
        F.sum(num("M", "=", "X", "I")).alias("aligned"),
        F.sum("m_").alias("matches"),
        F.sum("x_").alias("mismatches"),
        F.sum(num("I")).alias("insertions"),
        F.sum(num("D")).alias("deletions"),
        F.min_by(F.when(F.col("last_n_k") > F.coalesce("last_k", F.lit(0)), F.col("last_n")), "k").alias("intron_before"),
    )
    forward = F.col("strand") == "+"
    return b.withColumn("t_start", F.when(forward, F.col("lo")).otherwise(F.col("template_length") - F.col("hi"))).withColumn("t_end", F.when(forward, F.col("hi")).otherwise(F.col("template_length") - F.col("lo"))).drop("lo", "hi")


def collinear_groups(blocks: DataFrame) -> DataFrame:
    """blocks with grp: runs along the template in which each block follows the one before on the reference."""
    w = Window.partitionBy("query_name", "chrom", "strand").orderBy("t_start", "ord", "block")
    fits = (F.col("t_start") >= F.lag("t_end").over(w) - TOLERANCE) & F.when(F.col("strand") == "+", F.col("ref_start") >= F.lag("ref_end").over(w) - TOLERANCE).otherwise(F.col("ref_end") <= F.lag("ref_start").over(w) + TOLERANCE)
    return blocks.withColumn("new_", F.coalesce((~fits).cast("int"), F.lit(0))).withColumn("grp", F.sum("new_").over(w)).drop("new_")


def junctions(groups: DataFrame) -> DataFrame:
    """(query_name, chrom, strand, grp, start, stop): the introns between neighbouring blocks of one record, in genomic order."""
    genomic = Window.partitionBy("query_name", "chrom", "strand", "grp").orderBy("ref_start", "t_start", "ord", "block")
    j = groups.withColumn("prev", F.lag("ord").over(genomic)).withColumn("start", F.lag("ref_end").over(genomic))
    return j.where((F.col("prev") == F.col("ord")) & F.col("intron_before").isNotNull()).select("query_name", "chrom", "strand", "grp", "start", F.col("ref_start").alias("stop"))


def candidate_loci(groups: DataFrame, lengths: DataFrame | None = None, motifs: DataFrame | None = None) -> DataFrame:
    """One row per locus: coverage and identity with bases counted once, best scores, blocks and introns in genomic order, and its rank in the query.

    lengths (query_name, total_query_bases); without it the longest template of the query's records. motifs (chrom, start, stop,
    strand, canonical), one row a junction, says which are canonical: 1 or 0 in canonical_junctions, blank where it has no row.
    """
    locus = ["query_name", "chrom", "strand", "grp"]
    along = Window.partitionBy(*locus).orderBy("t_start", "ord", "block")
    g = groups.withColumn("prev_end", F.max("t_end").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    span = F.col("t_end") - F.col("t_start")
    over = F.least(F.greatest(F.lit(0), F.col("prev_end") - F.col("t_start")), span)
    part = F.when(F.col("prev_end").isNull() | (over == 0), 1.0).when(span == 0, 0.0).otherwise((span - over) / span)
    g = g.withColumn("part", part)
    genomic = Window.partitionBy(*locus).orderBy("ref_start", "t_start", "ord", "block")
    g = g.withColumn("intron", F.when(F.lag("ord").over(genomic) == F.col("ord"), F.col("intron_before")))
    if motifs is not None:
        g = g.withColumn("from_", F.lag("ref_end").over(genomic))
        known = motifs.select("chrom", "strand", F.col("start").alias("from_"), F.col("stop").alias("ref_start"), "canonical").distinct()
        g = g.join(known, ["chrom", "strand", "from_", "ref_start"], "left")
    else:
        g = g.withColumn("canonical", F.lit(None).cast("boolean"))
    flag = F.when(F.col("canonical"), "1").when(~F.col("canonical"), "0").otherwise("")
    listed = lambda c, f: F.array_join(F.transform(F.array_sort(F.collect_list(c)), f), ";")
    g = g.withColumn("first_ord", F.min("ord").over(Window.partitionBy("query_name", "chrom", "strand")))
    g = g.withColumn("longest", F.max("template_length").over(Window.partitionBy("query_name")))
    share = lambda c: F.sum(F.bround(F.col(c) * F.col("part"))).cast("long").alias(c)
    loci = g.groupBy(*locus, "first_ord", "longest").agg(
        F.count("*").alias("n_blocks"),
        F.min("ref_start").alias("ref_start"),
        F.max("ref_end").alias("ref_end"),
        *[share(c) for c in ("aligned", "matches", "mismatches", "insertions", "deletions")],
        F.max("mapq").alias("mapq"),
        F.max("as_score").alias("as_score"),
        F.max("is_primary").alias("is_primary"),
        listed(F.struct("ref_start", "ref_end"), lambda x: x["ref_start"].cast("string")).alias("block_starts"),
        listed(F.struct("ref_start", "ref_end"), lambda x: (x["ref_end"] - x["ref_start"]).cast("string")).alias("block_sizes"),
        listed(F.when(F.col("intron").isNotNull(), F.struct("ref_start", F.col("intron").alias("n"))), lambda x: x["n"].cast("string")).alias("intron_lengths"),
        listed(F.when(F.col("intron").isNotNull(), F.struct("ref_start", flag.alias("f"))), lambda x: x["f"]).alias("canonical_junctions"),
    )
    if lengths is not None:
        loci = loci.join(lengths.select("query_name", "total_query_bases"), "query_name", "left")
        total = F.coalesce("total_query_bases", F.lit(0))
    else:
        total = F.col("longest")
    denominator = F.col("matches") + F.col("mismatches") + F.col("insertions") + F.col("deletions")
    loci = loci.withColumn("identity", F.when(denominator > 0, F.col("matches") / denominator).otherwise(0.0)).withColumn("coverage", F.when(total > 0, F.col("aligned") / total).otherwise(0.0))
    rank = Window.partitionBy("query_name").orderBy(F.desc("is_primary"), F.desc_nulls_last("as_score"), F.desc("coverage"), F.desc("identity"), "first_ord", "grp")
    return loci.withColumn("rank", F.row_number().over(rank)).drop("first_ord", "longest", "total_query_bases")


def classify(loci: DataFrame, queries: DataFrame, exact_hits: DataFrame | None = None, best: tuple[float, float] = BEST, second: tuple[float, float] = SECOND) -> DataFrame:
    """One row per query of queries or loci: the best locus' evidence, primary and splice category, near-tied fractions.

    exact_hits (query_name, exact_hits): a perfect unique locus is exact only with one hit.
    """
    plausible = (F.col("coverage") >= second[0]) & (F.col("identity") >= second[1]) & (F.col("rank") > 1)
    top = Window.partitionBy("query_name")
    x = loci.withColumn("best_as", F.max(F.when(F.col("rank") == 1, F.col("as_score"))).over(top))
    near = [F.coalesce(F.max((F.col("rank") > 1) & (F.col("as_score") >= F.col("best_as") * (1 - f))), F.lit(False)).alias(f"near_{int(f * 100):02d}") for f in FRACTIONS]
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c)
    per = x.groupBy("query_name").agg(*[first(c) for c in ("chrom", "strand", "ref_start", "ref_end", "coverage", "identity", "as_score", "mapq", "n_blocks", "intron_lengths")], F.max(plausible).alias("has_second"), F.count("*").alias("n_loci"), *near)
    ids = queries.select("query_name").unionByName(loci.select("query_name")).distinct()
    y = ids.join(per, "query_name", "left")
    y = y.join(exact_hits, "query_name", "left").withColumn("exact_hits", F.coalesce("exact_hits", F.lit(0))) if exact_hits is not None else y.withColumn("exact_hits", F.lit(0))
    good = (F.col("coverage") >= best[0]) & (F.col("identity") >= best[1])
    perfect = (F.col("coverage") == 1.0) & (F.col("identity") == 1.0)
    spliced = F.col("intron_lengths") != ""
    none, poor = F.col("n_loci").isNull(), ~good
    primary = F.when(none, "unmapped").when(poor, "low_quality").when(F.col("has_second"), "ambiguous").when(perfect & (F.col("exact_hits") == 1), "exact_unique").otherwise("high_conf_unique")
    kind = F.when(spliced, "spliced").otherwise("unspliced")
    splice = F.when(none, "unmapped").when(poor, "low_quality").otherwise(F.concat(kind, F.when(F.col("has_second"), "_ambiguous").otherwise("_unique")))
    tied = F.concat_ws(";", *[F.when(F.col(f"near_{int(f * 100):02d}"), f"{f:g}") for f in FRACTIONS])
    y = y.withColumn("primary_category", primary).withColumn("splice_category", splice).withColumn("near_tied", tied)
    return y.drop(*[f"near_{int(f * 100):02d}" for f in FRACTIONS]).fillna({"n_loci": 0})


def usable_unique(primary: Column, splice: Column) -> Column:
    return F.coalesce(primary.isin("exact_unique", "high_conf_unique"), F.lit(False)) | F.coalesce(splice == "spliced_unique", F.lit(False))


def perfect_hits(records: DataFrame) -> DataFrame:
    """(query_name, chrom, start, stop, strand): records that match end to end without an edit, each place once."""
    full = F.col("cigar").rlike("^[0-9]+[M=]$") & (F.coalesce("nm", F.lit(0)) == 0)
    n = F.expr("cast(left(cigar, length(cigar) - 1) as int)")
    return records.where(full).select("query_name", "chrom", F.col("pos0").alias("start"), (F.col("pos0") + n).alias("stop"), "strand").distinct()


def occurrence_counts(hits: DataFrame) -> DataFrame:
    """(query_name, exact_hits): distinct places of each query."""
    return hits.select("query_name", "chrom", "start", "stop", "strand").distinct().groupBy("query_name").agg(F.count("*").alias("exact_hits"))
