"""Checks that return what is wrong, one row or text each; nothing is wrong where nothing comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.sources.readers import inventory

NAMESPACES = ("genbank", "refseq")


class CheckError(ValueError):
    """Raised by require() with all that is wrong."""


def require(problems: DataFrame, shown: int = 20) -> None:
    """Raises CheckError with the first problems if there are any."""
    rows = problems.limit(shown).collect()
    if rows:
        raise CheckError("; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows))


def manifest_problems(manifest: dict, required: tuple[str, ...]) -> list[str]:
    """Required fields that are missing or blank, in their order."""
    return [f"missing: {f}" for f in required if manifest.get(f) is None or str(manifest[f]).strip() == ""]


def policy_problems(preference: list[str], roles: list[str]) -> list[str]:
    """What is wrong with a contig policy: no, unknown or repeated namespaces, no roles."""
    out = [] if preference else ["no accession namespace"]
    out += [f"unknown namespace: {p}" for p in preference if p not in NAMESPACES]
    out += [f"repeated namespace: {p}" for p in sorted({p for p in preference if preference.count(p) > 1})]
    return out + ([] if roles else ["no roles"])


def file_problems(spark: SparkSession, expected: DataFrame) -> DataFrame:
    """(path, problem) of files held against expected (path, size, sha256; null is not checked): `missing`, `size` or `hash`.

    Files are read by tasks; paths come from one folder or more and are listed on the driver, as many as the evidence names.
    """
    paths = [r.path for r in expected.select("path").distinct().collect()]
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    there = []
    for p in paths:
        q = jvm.org.apache.hadoop.fs.Path(p)
        if q.getFileSystem(hadoop).exists(q):
            there.append(p)
    bare = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    if there:
        got = inventory(spark, there).select(bare(F.col("path")).alias("k"), F.col("size").alias("size_"), F.col("sha256").alias("sha_"))
    else:
        got = spark.createDataFrame([], "k string, size_ long, sha_ string")
    x = expected.withColumn("k", bare(F.col("path"))).join(got, "k", "left")
    p = F.when(F.col("sha_").isNull(), "missing").when(F.col("size") != F.col("size_"), "size").when(F.lower("sha256") != F.col("sha_"), "hash")
    return x.select("path", p.alias("problem")).where("problem is not null")


def checksum_problems(listed: DataFrame, frozen: DataFrame) -> DataFrame:
    """(path, problem) of frozen checksums (path, md5) against a listing's entries: `not_listed` or `changed`."""
    x = frozen.select("path", F.lower("md5").alias("want")).join(listed.select("path", "md5"), "path", "left")
    return x.select("path", F.when(F.col("md5").isNull(), "not_listed").when(F.col("md5") != F.col("want"), "changed").alias("problem")).where("problem is not null")


def log_facts(lines: DataFrame) -> DataFrame:
    """(fact, value, n) in the lines (line) of an aligner's log: index parts, k and w of the index, mapped sequences, warnings and errors."""
    facts = {
        "index_part": r"loaded/built the index for (\d+) target",
        "kmer": r"kmer size: (\d+)",
        "skip": r"skip: (\d+)",
        "mapped": r"mapped (\d+) sequences",
        "version": r"Version: (\S+)",
        "multi_part_warning": r"(multi-part index)",
        "error": r"(?i)(\berror\b)",
    }
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), F.regexp_extract_all("line", F.lit(v), F.lit(1)).alias("v")) for k, v in facts.items()])).alias("x")
    return lines.select(cells).select("x.fact", F.explode("x.v").alias("value")).groupBy("fact", "value").agg(F.count("*").alias("n"))


def index_log_problems(lines: DataFrame, k: int = 15, w: int = 5, hpc: bool = False, building: bool = True) -> DataFrame:
    """(problem, value) in the lines (line) of a spliced aligner's log: `overridden` settings, `no_index_line`, several `parts`, parts
    that `disagree`, a `kmer`, `skip` or `hpc` other than expected. With building false (a mapping against an index that is there) only the
    first and the third are looked for. One pass; an empty log has no index line."""
    stat = r"kmer size: (\d+); skip: (\d+); is_hpc: (\d+)"
    at = lambda i: F.regexp_extract("line", stat, i).cast("int")
    hit = F.col("line").rlike(stat)
    low = F.lower("line")
    x = lines.agg(
        F.count(F.when(low.contains("overridden by parameters used in the prebuilt index"), 1)).alias("o"), F.count(F.when(low.contains("multi-part index"), 1)).alias("m"), F.count(F.when(hit, 1)).alias("n"),
        *[f(F.when(hit, at(i))).alias(f"{c}{s}") for i, c in ((1, "k"), (2, "w"), (3, "h")) for f, s in ((F.min, "0"), (F.max, "1"))],
    )
    same = (F.col("k0") == F.col("k1")) & (F.col("w0") == F.col("w1")) & (F.col("h0") == F.col("h1"))
    rule = lambda c, name, v: F.when(c, F.struct(F.lit(name).alias("problem"), v.cast("string").alias("value")))
    rules = [rule(F.col("o") > 0, "overridden", F.col("o")), rule((F.col("n") > 1) | (F.col("m") > 0), "parts", F.greatest("n", "m"))]
    if building:
        rules += [rule(F.col("n") == 0, "no_index_line", F.lit(None)), rule(~same, "disagree", F.col("n"))]
        rules += [rule(same & (F.col(c) != v), name, F.col(c)) for c, name, v in (("k0", "kmer", k), ("w0", "skip", w), ("h0", "hpc", int(hpc)))]
    return x.select(F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("r")).select("r.problem", "r.value")


def probe_problems(records: DataFrame, expected: DataFrame, contigs: DataFrame) -> DataFrame:
    """(query_name, problem, n) of probe queries (query_name): `primary_records` where other than one primary mapped record is there (n of
    them; secondary ones don't matter), `foreign_contig` where the one lies on none of contigs (chrom). records are mapped_records()."""
    p = records.where("is_primary").select("query_name", "chrom").join(contigs.select("chrom", F.lit(1).alias("known")).distinct(), "chrom", "left")
    per = p.groupBy("query_name").agg(F.count("*").alias("k"), F.count("known").alias("own"))
    x = expected.where("query_name is not null").select("query_name").distinct().join(per, "query_name", "left").fillna(0, ["k", "own"])
    problem = F.when(F.col("k") != 1, "primary_records").when(F.col("own") == 0, "foreign_contig")
    return x.select("query_name", problem.alias("problem"), F.col("k").alias("n")).where("problem is not null")


def high_water(ledger: DataFrame, key: str = "stage", value: str = "bytes") -> DataFrame:
    """(key, value): the most that each stage of a ledger used; entries are states, so they aren't added up."""
    return ledger.groupBy(key).agg(F.max(value).alias(value))


def preflight_problems(ram_gib: float | None, free_disk_gib: float | None, threads: int, least_ram: float, least_disk: float, most_threads: int) -> list[str]:
    """Why a host may not run a stage; unknown resources are a reason."""
    out = []
    if ram_gib is None or ram_gib < least_ram:
        out.append(f"memory {ram_gib} GiB, {least_ram} needed")
    if free_disk_gib is None or free_disk_gib < least_disk:
        out.append(f"free disk {free_disk_gib} GiB, {least_disk} needed")
    if threads > most_threads:
        out.append(f"{threads} threads, {most_threads} allowed")
    return out
