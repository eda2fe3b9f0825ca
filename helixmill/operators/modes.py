"""Mapping rows of two alignments of the same queries, a row per query and mode, and what is summed up and checked over them.

Mode `primary` is judged on the contiguous alignment, `splice` on the spliced one. Rows have the best and the second locus in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators import summaries as S
from helixmill.operators.alignment import BEST, SECOND, classify

MODES = ("primary", "splice")
LOCUS = ("chrom", "start", "end", "strand", "block_count", "block_starts", "block_sizes", "coverage", "identity", "mapq", "alignment_score", "intron_lengths", "canonical_junctions")
SECONDARY = "best_secondary_"
#: The 36 columns of a mapping table, in order.
COLUMNS = ("sample_id", "is_control", "stratum", "build", "mode", "category", "exact_occurrence_count", "best_is_perfect", "perfect_unique_candidate", *LOCUS, *(SECONDARY + c for c in LOCUS), "near_tied_fractions")
ALLOWED = ("exact_unique", "high_conf_unique", "ambiguous", "low_quality", "unmapped", "spliced_unique", "spliced_ambiguous", "unspliced_unique", "unspliced_ambiguous")


def _mode(loci: DataFrame, ids: DataFrame, exact: DataFrame | None, mode: str) -> DataFrame:
    """A row per query of ids: what classify() says of this alignment and both loci's columns; absent loci have 0 blocks and nulls."""
    c = classify(loci, ids, exact).select("query_name", F.col(f"{mode}_category").alias("category"), "exact_hits", F.coalesce("has_second", F.lit(False)).alias("has_second"), "near_tied", F.coalesce((F.col("coverage") == 1.0) & (F.col("identity") == 1.0), F.lit(False)).alias("perfect"))
    cell = F.struct("chrom", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), "strand", F.col("n_blocks").alias("block_count"), "block_starts", "block_sizes", "coverage", "identity", "mapq", F.col("as_score").alias("alignment_score"), "intron_lengths", "canonical_junctions")
    two = loci.where("rank <= 2").groupBy("query_name").agg(F.max(F.when(F.col("rank") == 1, cell)).alias("b"), F.max(F.when(F.col("rank") == 2, cell)).alias("s"))
    x = c.join(two, "query_name", "left")
    column = lambda v, k, name: (F.coalesce(F.col(f"{v}.{k}"), F.lit(0)) if k == "block_count" else F.col(f"{v}.{k}")).alias(name)
    first = mode == MODES[0]
    only = lambda v, kind: (v if first else F.lit(None)).cast(kind)
    return x.select(
        F.col("query_name").alias("sample_id"), F.lit(mode).alias("mode"), "category", only(F.col("exact_hits"), "long").alias("exact_occurrence_count"), only(F.col("perfect"), "boolean").alias("best_is_perfect"), only(F.col("perfect") & ~F.col("has_second"), "boolean").alias("perfect_unique_candidate"),
        *[column("b", k, k) for k in LOCUS], *[column("s", k, SECONDARY + k) for k in LOCUS], F.col("near_tied").alias("near_tied_fractions"),
    )


def mode_rows(primary: DataFrame, splice: DataFrame, expected: DataFrame, exact: DataFrame | None = None, build: str = "one") -> DataFrame:
    """COLUMNS, two rows per query of expected (sample_id, stratum; a null stratum is a control) or of the loci of either alignment.

    Queries that neither alignment has get unmapped rows. Exact occurrences are evidence of the primary mode alone.
    """
    e = expected.where("sample_id is not null").groupBy("sample_id").agg(F.min("stratum").alias("stratum"))
    ids = e.select(F.col("sample_id").alias("query_name")).unionByName(primary.select("query_name")).unionByName(splice.select("query_name")).distinct()
    both = _mode(primary, ids, exact, MODES[0]).unionByName(_mode(splice, ids, None, MODES[1]))
    x = both.join(e, "sample_id", "left").withColumn("is_control", F.col("stratum").isNull()).withColumn("stratum", F.coalesce("stratum", F.lit("control"))).withColumn("build", F.lit(build))
    return x.select(*COLUMNS)


def wide_rows(rows: DataFrame) -> DataFrame:
    """A row per query with the categories of both modes side by side and whether it is usable, in the shape of the summaries.

    The splice row is optional; the chromosome is that of either mode, the primary one first. A query twice in a mode raises.
    """
    p, s = (rows.where(F.col("mode") == m) for m in MODES)
    own = p.select(F.col("sample_id").alias("query_name"), "is_control", "stratum", F.col("category").alias("primary_category"), F.col("chrom").alias("chrom_p"), F.col("start").alias("ref_start"), F.col("end").alias("ref_end"), "strand", "coverage", "identity", F.col("exact_occurrence_count").alias("exact_hits"), F.col("near_tied_fractions").alias("near_tied"))
    other = s.select(F.col("sample_id").alias("query_name"), F.col("is_control").alias("c_"), F.col("stratum").alias("t_"), F.col("category").alias("splice_category"), F.col("chrom").alias("chrom_s"))
    x = own.join(other, "query_name", "full_outer")
    x = x.withColumn("is_control", F.coalesce("is_control", "c_")).withColumn("stratum", F.coalesce("stratum", "t_")).withColumn("chrom", F.coalesce("chrom_p", "chrom_s")).drop("c_", "t_", "chrom_p", "chrom_s")
    return S.with_usability(x)


def quality_deciles(rows: DataFrame) -> DataFrame:
    """(mode, field, decile, n) of coverage and identity of mapped rows."""
    both = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("coverage", "identity")])
    x = rows.where("not is_control and coverage is not null").select("mode", F.explode(both).alias("x")).select("mode", "x.field", F.least(F.lit(9), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x.v"))) * 10)).cast("int").alias("decile"))
    return x.groupBy("mode", "field", "decile").agg(F.count("*").alias("n"))


def retention_by_contig(wide: DataFrame, contigs: DataFrame) -> DataFrame:
    """Usable rates by scope and the category of the contig, from contigs (contig, category), a table of some hundreds to millions
    of names, joined as Spark sees fit. Rows without a chromosome or with a contig that isn't listed are left out."""
    m = wide.join(contigs.select(F.col("contig").alias("chrom"), "category").distinct(), "chrom")
    return S.retention_by(m, "category")


def build_summary(rows: DataFrame, observations: DataFrame, deciles: DataFrame, contigs: DataFrame) -> dict[str, DataFrame]:
    """The tables of one build over its stored mapping rows. observations (query_name, protein_id, y); deciles (query_name, gc_decile, complexity_decile)."""
    wide = wide_rows(rows)
    by = wide.join(deciles, "query_name")
    classes = S.retention_by_class(wide, observations)
    return {
        "categories": rows.groupBy("mode", "is_control", "category").agg(F.count("*").alias("n")), "usable": S.usable_rates(wide), "contiguous_or_rescued": S.contiguous_or_rescued(wide), "quality": quality_deciles(rows),
        "near_tied": S.near_tied_sensitivity(wide), "by_class": classes, "gaps": S.retention_gaps(classes), "by_gc": S.retention_by(by, "gc_decile"), "by_complexity": S.retention_by(by, "complexity_decile"), "by_contig": retention_by_contig(wide, contigs),
    }


def summary_cells(tables: dict[str, DataFrame]) -> DataFrame:
    """(part, cell, successes, total) of the counting tables of build_summary in one: cell names the keys, missing ones are blank."""
    keys = {"categories": ("mode", "is_control", "category"), "usable": ("scope",), "contiguous_or_rescued": ("part", "stratum"), "quality": ("mode", "field", "decile"), "by_class": ("scope", "protein_id", "y"), "by_gc": ("scope", "gc_decile"), "by_complexity": ("scope", "complexity_decile"), "by_contig": ("scope", "category")}
    out = None
    for part, k in keys.items():
        t = tables[part]
        cell = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in k])
        n = "n" if "n" in t.columns else "total"
        x = t.select(F.lit(part).alias("part_"), cell.alias("cell"), (F.col("successes") if "successes" in t.columns else F.col(n)).cast("long").alias("successes"), F.col(n).cast("long").alias("total"))
        out = x if out is None else out.unionByName(x)
    return out.withColumnRenamed("part_", "part")


def reconcile(assignments: DataFrame, rows: DataFrame | None, expected_total: int, expected_representative: int, expected_controls: int, builds: tuple[str, ...] = (), modes: tuple[str, ...] = (), controls: DataFrame | None = None) -> DataFrame:
    """(check, build, mode, is_control, expected, observed, status) of sample assignments (sample_id, stratum) and mapping rows against
    the counts that were to come. Without rows the mapping checks have the status not_evaluated.

    Two passes, one over each table; what comes to the driver is a row per build, mode and control flag. controls (sample_id): the
    control ids that must be there; without it those that are. builds and modes that must be there; without them those that are.
    """
    spark = assignments.sparkSession
    a = assignments.groupBy("sample_id").agg(F.count("*").alias("k"), F.count(F.when(F.col("stratum") == "representative", 1)).alias("rep"), F.count(F.when(F.col("stratum").isin(*S.STRATA), 1)).alias("ok"))
    t = a.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("extra"), F.coalesce(F.sum("rep"), F.lit(0)).alias("rep"), F.coalesce(F.sum(F.col("k") - F.col("ok")), F.lit(0)).alias("odd"), F.count("sample_id").alias("ids")).first()
    out: list[tuple] = []

    def check(name: str, expected: int, observed: int, build: str | None = None, mode: str | None = None, is_control: bool | None = None, evaluated: bool = True) -> None:
        out.append((name, build, mode, is_control, int(expected), int(observed), "not_evaluated" if not evaluated else "passed" if expected == observed else "failed"))

    check("sample_total", expected_total, t.rows)
    check("sample_uniqueness", 0, t.extra)
    check("representative_count", expected_representative, t.rep)
    check("stratum_partition", 0, t.odd)
    kind = "check string, build string, mode string, is_control boolean, expected long, observed long, status string"
    if rows is None:
        for name in ("empty_mapping_results", "invalid_category", "control_count", "unknown_sample_ids"):
            check(name, 0, 0, evaluated=False)
        return spark.createDataFrame(out, kind)
    known = assignments.where("sample_id is not null").select("sample_id").distinct().withColumn("in_sample", F.lit(True))
    c = rows.groupBy("sample_id", "build", "mode", "is_control").agg(F.count("*").alias("k"), F.count(F.when(~F.col("category").isin(*ALLOWED) | F.col("category").isNull(), 1)).alias("bad")).join(known, "sample_id", "left")
    if controls is not None:
        c = c.join(controls.where("sample_id is not null").select("sample_id").distinct().withColumn("in_controls", F.lit(True)), "sample_id", "left")
    else:
        c = c.withColumn("in_controls", F.col("is_control"))
    # an id of several builds or modes is counted once over all of them by its first row
    first = F.row_number().over(Window.partitionBy("sample_id", "is_control").orderBy("build", "mode")) == 1
    c = c.withColumn("first", first)
    yes = lambda v: F.count(F.when(v, 1))
    in_sample, in_controls = F.coalesce("in_sample", F.lit(False)), F.coalesce("in_controls", F.lit(False))
    g = c.groupBy("build", "mode", "is_control").agg(F.sum("k").alias("rows"), F.count("*").alias("ids"), F.sum("bad").alias("bad"), yes(F.col("first")).alias("new"), yes(F.col("first") & ~in_sample).alias("unknown"), yes(in_sample).alias("sampled"), yes(in_controls).alias("controls")).collect()
    at = {(r.build, r.mode, r.is_control): r for r in g}
    n_controls = sum(r.new for r in g if r.is_control)
    universe = controls.where("sample_id is not null").select("sample_id").distinct().count() if controls is not None else n_controls
    wanted = expected_total or expected_controls
    check("empty_mapping_results", 0, int(bool(wanted) and not g))
    check("invalid_category", 0, sum(r.bad for r in g))
    check("control_count", expected_controls, n_controls)
    check("unknown_sample_ids", 0, sum(r.unknown for r in g if not r.is_control))
    for build in builds or tuple(sorted({r.build for r in g})):
        for mode in modes or tuple(sorted({r.mode for r in g})):
            for is_control in (False, True):
                r = at.get((build, mode, is_control))
                n, ids = (r.rows, r.ids) if r else (0, 0)
                there = (r.controls if is_control else r.sampled) if r else 0
                check("one_category_per_row", n, ids, build, mode, is_control)
                check("missing_mapping_ids", universe if is_control else t.ids, there, build, mode, is_control)
                check("category_row_count", universe if is_control else expected_total, n, build, mode, is_control)
    return spark.createDataFrame(out, kind)
