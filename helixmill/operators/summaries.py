"""Rates, histograms, retention, comparison and reconciliation tables over mapping rows (one per query).

Rows flagged is_control are left out everywhere but in control_alerts. Scopes: `combined` (usable in either way), `primary`, `splice`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.sequence import decile
from helixmill.functions.stats import rate_columns
from helixmill.operators.alignment import FRACTIONS, usable_unique

SEVERE_RETENTION = 0.50
SEVERE_GAP = 0.40
CATEGORIES = ("exact_unique", "high_conf_unique", "ambiguous", "low_quality", "unmapped")
STRATA = ("representative", "quota", "filler")


def with_usability(m: DataFrame) -> DataFrame:
    p, s = F.col("primary_category"), F.col("splice_category")
    return m.withColumn("use_primary", F.coalesce(p.isin("exact_unique", "high_conf_unique"), F.lit(False))).withColumn("use_splice", F.coalesce(s == "spliced_unique", F.lit(False))).withColumn("usable", usable_unique(p, s))


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """point, lower and upper rounded, for comparison across engines."""
    return df.select(*[F.round(c, places).alias(c) if c in ("point", "lower", "upper") else F.col(c) for c in df.columns])


def _kept(m: DataFrame) -> DataFrame:
    return m.where(~F.col("is_control"))


def _scoped(m: DataFrame) -> DataFrame:
    """m three times, once a scope, with the flag `use`."""
    flags = F.array(*[F.struct(F.lit(s).alias("scope"), F.col(c).alias("use")) for s, c in (("combined", "usable"), ("primary", "use_primary"), ("splice", "use_splice"))])
    return m.withColumn("s_", F.explode(flags)).select("*", "s_.scope", "s_.use").drop("s_")


def _count_if(flag: Column) -> Column:
    return F.count(F.when(flag, 1))


def _modes(m: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.lit("primary").alias("mode"), F.col("primary_category").alias("category")), F.struct(F.lit("splice").alias("mode"), F.col("splice_category").alias("category")))
    return m.select("query_name", "is_control", F.explode(both).alias("x")).select("query_name", "is_control", "x.mode", "x.category")


def category_table(m: DataFrame) -> DataFrame:
    return _modes(m).groupBy("mode", "is_control", "category").agg(F.count("*").alias("n"))


def category_rates(m: DataFrame) -> DataFrame:
    per = _modes(_kept(m)).groupBy("mode", "category").agg(F.count("*").alias("k"))
    total = _kept(m).agg(F.count("*").alias("n"))
    return per.join(F.broadcast(total)).select("mode", "category", *rate_columns(F.col("k"), F.col("n")))  # one row


def usable_rates(m: DataFrame) -> DataFrame:
    per = _scoped(_kept(m)).groupBy("scope").agg(_count_if(F.col("use")).alias("k"), F.count("*").alias("n"))
    return per.select("scope", *rate_columns(F.col("k"), F.col("n")))


def contiguous_or_rescued(m: DataFrame) -> DataFrame:
    part = F.when(F.col("use_primary"), "contiguous_usable").when(F.col("use_splice"), "splice_rescued").otherwise("still_unusable")
    return _kept(m).groupBy(part.alias("part"), "stratum").agg(F.count("*").alias("n"))


def quality_deciles(m: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.lit("coverage").alias("field"), F.col("coverage").alias("v")), F.struct(F.lit("identity").alias("field"), F.col("identity").alias("v")))
    x = _kept(m).where("coverage is not null").select(F.explode(both).alias("x")).select("x.field", decile(F.col("x.v"), 1.0).alias("decile"))
    return x.groupBy("field", "decile").agg(F.count("*").alias("n"))


def strand_locus(m: DataFrame) -> DataFrame:
    per = _kept(m).where("chrom is not null").groupBy("chrom", "ref_start", "ref_end", "strand").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum(F.when(F.col("strand") == "+", F.col("n"))), F.lit(0)).alias("forward_strand"), F.coalesce(F.sum(F.when(F.col("strand") == "-", F.col("n"))), F.lit(0)).alias("reverse_strand"), F.count("*").alias("distinct_loci"), F.coalesce(F.max("n"), F.lit(0)).alias("max_rows_per_locus"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_rows_per_locus"))


def near_tied_sensitivity(m: DataFrame) -> DataFrame:
    """Rows whose second locus scores within each fraction of the best; the total counts unmapped rows too."""
    f = F.explode(F.array(*[F.lit(f"{x:g}") for x in FRACTIONS])).alias("fraction")
    return _kept(m).select(f, F.split("near_tied", ";").alias("t")).groupBy("fraction").agg(_count_if(F.expr("array_contains(t, fraction)")).alias("triggered"), F.count("*").alias("total"))


def control_alerts(m: DataFrame) -> DataFrame:
    """Controls that are usable: any row is an alert."""
    return m.where("is_control and use_primary").select("query_name", "primary_category")


def exact_discordance(m: DataFrame) -> DataFrame:
    """Perfect loci without a plausible second one, by whether the exact search found another number of places than one."""
    c = _kept(m).where((F.col("coverage") == 1.0) & (F.col("identity") == 1.0) & ~F.coalesce("has_second", F.lit(False)))
    return c.groupBy((F.col("exact_hits") != 1).alias("discordant")).agg(F.count("*").alias("n"))


def retention_by_class(m: DataFrame, observations: DataFrame) -> DataFrame:
    """Usable rates by scope, protein and class, and over all proteins (protein_id null), in one pass. observations (query_name, protein_id, y)."""
    base = _kept(m).select("query_name", "usable", "use_primary", "use_splice")
    x = _scoped(base.join(observations, "query_name"))
    per = x.groupingSets([[F.col("scope"), F.col("protein_id"), F.col("y")], [F.col("scope"), F.col("y")]], "scope", "protein_id", "y").agg(_count_if(F.col("use")).alias("k"), F.count("*").alias("n"))
    return per.select("scope", "protein_id", "y", *rate_columns(F.col("k"), F.col("n")))


def retention_gaps(by_class: DataFrame) -> DataFrame:
    """Positive less negative rate where both classes occur, with the alerts."""
    x = by_class.groupBy("scope", "protein_id").agg(F.max(F.when(F.col("y") == 1, F.col("point"))).alias("a"), F.max(F.when(F.col("y") == 0, F.col("point"))).alias("b")).where("a is not null and b is not null")
    gap = F.col("a") - F.col("b")
    return x.select("scope", "protein_id", gap.alias("gap"), (F.abs(gap) >= SEVERE_GAP).alias("severe_gap"), (F.least("a", "b") < SEVERE_RETENTION).alias("severe_retention"))


def retention_by(m: DataFrame, column: str) -> DataFrame:
    per = _scoped(_kept(m)).groupBy("scope", column).agg(_count_if(F.col("use")).alias("k"), F.count("*").alias("n"))
    return per.select("scope", column, *rate_columns(F.col("k"), F.col("n")))


def compare_builds(one: DataFrame, two: DataFrame) -> DataFrame:
    a = one.select("query_name", F.col("primary_category").alias("c1"), F.col("usable").cast("double").alias("u1"))
    b = two.select("query_name", F.col("primary_category").alias("c2"), F.col("usable").cast("double").alias("u2"))
    x = a.join(b, "query_name").agg(F.count("*").alias("compared"), _count_if(F.col("c1") != F.col("c2")).alias("category_changed"), F.avg("u1").alias("r1"), F.avg("u2").alias("r2"))
    return x.select("compared", "category_changed", F.round("r1", 9).alias("rate_one"), F.round("r2", 9).alias("rate_two"), F.round(F.abs(F.col("r1") - F.col("r2")) * 100, 7).alias("gap_points"))


def reconcile(assignments: DataFrame, m: DataFrame) -> DataFrame:
    """(check, observed, status): 11 checks of the assignments against the mapping rows."""
    a = assignments.select("sample_id", "stratum").distinct()
    ids = a.where("sample_id is not null").select(F.col("sample_id").alias("query_name")).distinct()

    def check(name: str, df: DataFrame, good: Column, observed: Column | None = None) -> DataFrame:
        n = F.count("*") if observed is None else observed
        return df.agg(n.alias("observed"), F.count("*").alias("rows_")).select(F.lit(name).alias("check"), "observed", F.when(good, "passed").otherwise("failed").alias("status"))

    some, none = F.col("rows_") > 0, F.col("rows_") == 0
    checks = [
        check("sample_total", a, some, F.count_distinct("sample_id")),
        check("sample_uniqueness", a.groupBy("sample_id").count().where("count > 1"), none),
        check("representative_count", a.where("stratum = 'representative'"), some),
        check("stratum_partition", a.where(F.col("stratum").isNull() | ~F.col("stratum").isin(*STRATA)), none),
        check("empty_mapping_results", m, some),
        check("invalid_category", m.where(~F.col("primary_category").isin(*CATEGORIES)), none),
        check("control_count", m.where("is_control"), some),
        check("unknown_sample_ids", m.join(ids, "query_name", "left_anti"), none),
        check("one_category_per_row", m.groupBy("query_name").count().where("count > 1"), none),
        check("missing_mapping_ids", ids.join(m, "query_name", "left_anti"), none),
        check("category_row_count", _kept(m), some),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
