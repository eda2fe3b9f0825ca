"""Writers: FASTA, TSV, BED, SAM and JSON. Tables go through Spark's commit protocol; small documents are written beside and renamed."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_fasta(df: DataFrame, path: str, name: str = "id", seq: str = "seq") -> None:
    """One header and one sequence line a record."""
    df.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)


def write_derived_fasta(contigs: DataFrame, policy: DataFrame, path: str) -> dict:
    """The contigs that a policy keeps as FASTA, and its manifest: their number, bases by class and a digest that doesn't depend on
    the order. Written beside and renamed into place only if every kept accession is there once and whole; else ValueError."""
    from helixmill.functions.sequence import base_classes
    from helixmill.sources.readers import selected_contigs

    spark = contigs.sparkSession
    kept, problems = selected_contigs(contigs, policy)
    bad = problems.orderBy("accession").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r.accession}: {r.problem}" for r in bad))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, beside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.part-{uuid.uuid4().hex}"))
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise ValueError(f"{path} is there")
    write_fasta(kept, beside.toString())
    classes = base_classes("seq")
    row = kept.agg(F.count("*").alias("contigs"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"), *[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in classes.items()], F.expr("bit_xor(xxhash64(id, sha2(seq, 256)))").alias("digest")).first()
    if not fs.rename(beside, target):
        raise OSError(f"{path} was not written")
    return row.asDict()


def write_tsv(df: DataFrame, path: str, header: bool = True, compress: bool = False) -> None:
    """Columns as text; arrays joined by semicolons, null as blank."""
    cols = [F.concat_ws(";", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.option("sep", "\t").option("header", header).option("nullValue", "").option("emptyValue", "").option("compression", "gzip" if compress else "none").csv(path)


def write_bed(df: DataFrame, path: str) -> None:
    """Hits (name, chrom, start, stop, strand) as six columns with score 0."""
    df.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string"), "name", F.lit("0"), "strand").alias("value")).write.text(path)


def write_sam(df: DataFrame, path: str) -> None:
    """Alignment records with NM and AS tags where they are known; other nulls become * or 0."""
    tag = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}:i:"), F.col(c).cast("string")))
    text = [F.coalesce(F.col(c).cast("string"), F.lit("*" if c in ("query_name", "chrom", "cigar") else "0")) for c in ("query_name", "flag", "chrom", "pos1", "mapq", "cigar")]
    df.select(F.concat_ws("\t", *text, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), tag("NM", "nm"), tag("AS", "as_score")).alias("value")).write.text(path)


def write_json(document: dict, path: str) -> None:
    """Keys sorted; readers never see half a file."""
    tmp = Path(f"{path}.tmp-{os.getpid()}")
    tmp.write_text(json.dumps(document, indent=2, sort_keys=True) + "\n")
    os.replace(tmp, path)


def fixed_decimals(x: float | None, places: int = 6) -> str:
    """Text of a number with so many decimals, rounded half to even in binary; blank for null. Spark's own format rounds half up."""
    return "" if x is None else f"{x:.{places}f}"


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to a Parquet table, such as refused attempts."""
    df.write.mode("append").parquet(path)
