"""Readers of the text formats: labelled CSV, FASTA, SAM, BED, assembly report, index, mapping TSV, checksum and path listings.

Files are read by Spark in splits; a .gz file is one split. Lines of FASTA sequences are put together record by record, so a
record must fit into a task's memory; chunked() cuts long ones for everything after.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.functions.names import UNMAPPED, flag_set, listing_path, listing_path_problem

LABELLED = T.StructType([T.StructField("sequence", T.StringType()), T.StructField("labels", T.StringType())])
BED6 = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("name", T.StringType()), T.StructField("score", T.StringType()), T.StructField("strand", T.StringType())])
FAI = T.StructType([T.StructField("name", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("length", "offset", "line_bases", "line_bytes")]])
#: Columns of an assembly report that has no header line.
ASSEMBLY = ("Sequence-Name", "Sequence-Role", "Assigned-Molecule", "Assigned-Molecule-Location/Type", "GenBank-Accn", "Relationship", "RefSeq-Accn", "Assembly-Unit", "Sequence-Length", "UCSC-style-name")
CHUNK = 1 << 16


class SourceError(ValueError):
    """A file that breaks its format."""


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, sample_id, sequence, labels) of a CSV whose header is exactly sequence,labels; blank labels are ''.

    row_index is the place in the file from 0; for that the splits are counted first and nothing is shuffled.
    """
    head = spark.read.text(path).limit(1).collect()
    if not head or head[0][0].lstrip("﻿").rstrip("\r") != "sequence,labels":
        raise SourceError("the header must be sequence,labels")
    df = spark.read.schema(LABELLED).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    with_id = df.withColumn("m", F.monotonically_increasing_id())
    part = F.shiftright(F.col("m"), 33)
    sizes = sorted(with_id.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row per split
    start, base = {}, 0
    for r in sizes:
        start[r.part] = base
        base += r.n
    if not start:
        return df.select(F.lit(0).cast("long").alias("row_index"), F.lit("").alias("sample_id"), "sequence", "labels").limit(0)
    offsets = F.broadcast(spark.createDataFrame(list(start.items()), "part_ long, offset_ long"))  # a row a split
    x = with_id.join(offsets, part == F.col("part_")).withColumn("row_index", F.col("offset_") + F.col("m").bitwiseAND((1 << 33) - 1))
    return x.select("row_index", F.concat(F.lit("row_"), F.col("row_index").cast("string")).alias("sample_id"), F.coalesce("sequence", F.lit("")).alias("sequence"), F.coalesce("labels", F.lit("")).alias("labels"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq): id is the header's first word; sequence lines are joined, blank ones skipped, CRLF read as LF."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "\r", "").alias("v"))
    raw = raw.select(F.regexp_replace("v", "^>", "").alias("v")).where(F.trim("v") != "")
    head = F.substring_index("v", "\n", 1)
    seq = F.when(F.instr("v", "\n") > 0, F.regexp_replace(F.expr("substring(v, instr(v, '\n') + 1)"), r"\s", "")).otherwise("")
    return raw.select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\s*\S*", "")).alias("description"), seq.alias("seq"))


def chunked(contigs: DataFrame, size: int = CHUNK, name: str = "id", seq: str = "seq") -> DataFrame:
    """(name, chunk, seq) in pieces of `size` bases, for access by position."""
    n = F.greatest(F.lit(1), F.ceil(F.length(seq) / size)).cast("int")
    x = contigs.select(F.col(name), F.col(seq).alias("s_"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return x.select(name, "chunk", F.substr(F.col("s_"), F.col("chunk") * size + 1, F.lit(size)).alias("seq"))


def fetch(chunks: DataFrame, wanted: DataFrame, size: int = CHUNK, name: str = "id") -> DataFrame:
    """wanted (name, start, stop, ...) with `bases`: the half-open span of each; '' where the name is unknown or the span is out of bounds."""
    w = wanted
    ends = chunks.groupBy(name).agg(F.max(F.struct("chunk", F.length("seq").alias("n"))).alias("m")).select(name, (F.col("m.chunk") * size + F.col("m.n")).alias("total_"))
    need = w.where((F.col("start") >= 0) & (F.col("stop") > F.col("start"))).select(name, "start", "stop").distinct().select(name, "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / size).cast("int"), F.floor((F.col("stop") - 1) / size).cast("int"))).alias("chunk"))
    got = need.join(chunks, [name, "chunk"]).groupBy(name, "start", "stop").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]), "").alias("s_"), F.min("chunk").alias("c_"))
    x = w.join(got, [name, "start", "stop"], "left").join(ends, name, "left")
    ok = F.col("s_").isNotNull() & (F.col("stop") <= F.col("total_"))
    return x.withColumn("bases", F.when(ok, F.substr(F.col("s_"), (F.col("start") - F.col("c_") * size + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))).otherwise("")).drop("s_", "c_", "total_").select(*wanted.columns, "bases")


def sam(spark: SparkSession, path: str) -> DataFrame:
    """(ord, query_name, flag, chrom, pos1, mapq, cigar, nm, as_score) of the mapped records; of repeated tags the last holds.

    Headers, unmapped records and records without reference or CIGAR are left out. Lines of under 11 columns raise in the task.
    """
    t = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where((F.col("value") != "") & ~F.col("value").startswith("@"))
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    t = t.select("ord", f.alias("f")).withColumn("f", F.when(F.size("f") >= 11, F.col("f")).otherwise(F.raise_error(F.lit("a SAM line of under 11 columns"))))
    tag = lambda name: F.expr(f"try_cast(substring(try_element_at(filter(slice(f, 12, greatest(size(f) - 11, 0)), x -> startswith(x, '{name}:i:')), -1), 6) as int)")
    x = t.select("ord", F.col("f")[0].alias("query_name"), F.col("f")[1].cast("int").alias("flag"), F.col("f")[2].alias("chrom"), F.col("f")[3].cast("int").alias("pos1"), F.col("f")[4].cast("int").alias("mapq"), F.col("f")[5].alias("cigar"), tag("NM").alias("nm"), tag("AS").alias("as_score"))
    return x.where(~flag_set(F.col("flag"), UNMAPPED) & (F.col("chrom") != "*") & (F.col("cigar") != "*"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Distinct hits (name, chrom, start, stop, strand) of a BED file of six columns or more."""
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    t = spark.read.text(path).where(F.trim("value") != "").select(f.alias("f")).withColumn("f", F.when(F.size("f") >= 6, F.col("f")).otherwise(F.raise_error(F.lit("a BED line of under 6 columns"))))
    return t.select(F.col("f")[3].alias("name"), F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("stop"), F.col("f")[5].alias("strand")).distinct()


def assembly_report(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_name, role, molecule, genbank, refseq, unit, length); columns by the last comment line that names Sequence-Name."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("v")).where(F.col("v") != "")
    heads = [r.v for r in lines.where(F.col("v").startswith("#") & F.col("v").contains("Sequence-Name")).withColumn("o", F.monotonically_increasing_id()).orderBy(F.desc("o")).limit(1).collect()]
    columns = heads[-1].lstrip("#").strip().split("\t") if heads else list(ASSEMBLY)
    f = F.split("v", "\t")
    at = lambda c: F.coalesce(F.try_element_at(f, F.lit(columns.index(c) + 1)), F.lit("")) if c in columns else F.lit("")
    x = lines.where(~F.col("v").startswith("#"))
    return x.select(
        at("Sequence-Name").alias("sequence_name"), at("Sequence-Role").alias("role"), at("Assigned-Molecule").alias("molecule"), at("GenBank-Accn").alias("genbank"), at("RefSeq-Accn").alias("refseq"), at("Assembly-Unit").alias("unit"), F.coalesce(F.nullif(at("Sequence-Length"), F.lit("")).cast("long"), F.lit(0)).alias("length")
    )


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAI).option("sep", "\t").option("mode", "FAILFAST").csv(path)


def build_fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, offset, line_bases, line_bytes) of uncompressed FASTA files, each read whole by a task.

    Lines of one record must be equally long but for its last; else the task raises.
    """

    def entries(content: bytes) -> Iterator[tuple[str, int, int, int, int]]:
        at, now = 0, None
        for line in content.splitlines(keepends=True):
            bare = line.rstrip(b"\r\n")
            if line.startswith(b">"):
                if now:
                    yield tuple(now[:5])
                now = [(bare[1:].split() or [b""])[0].decode(), 0, at + len(line), 0, 0, False]
            elif now and bare:
                if now[5] or (now[3] and len(bare) > now[3]):
                    raise SourceError(f"uneven lines in {now[0]}")
                if not now[3]:
                    now[3], now[4] = len(bare), len(line)
                now[5] = len(bare) < now[3]
                now[1] += len(bare)
            at += len(line)
        if now:
            yield tuple(now[:5])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                cols = list(zip(*entries(content))) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=[f.name for f in FAI])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, FAI)


def mapping_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Mapping rows with typed columns; blanks are null."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("nullValue", "").option("mode", "FAILFAST").csv(path)


def checksum_listing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, problems) of lines `md5 path`. entries (path, md5): well-formed lines of paths that occur once. problems (path, problem)."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r$", "")).alias("v")).where(F.col("v") != "")
    x = lines.select("v", F.lower(F.regexp_extract("v", r"^(\S+)\s+(\S.*)$", 1)).alias("md5"), F.regexp_extract("v", r"^(\S+)\s+(\S.*)$", 2).alias("raw"))
    bad = F.when(F.col("raw") == "", "malformed_line").when(~F.col("md5").rlike("^[0-9a-f]{32}$"), "malformed_token").when(listing_path_problem(F.col("raw")).isNotNull(), F.concat(F.lit("malformed_path_"), listing_path_problem(F.col("raw"))))
    x = x.withColumn("problem", bad)
    good = x.where("problem is null").select(listing_path(F.col("raw")).alias("path"), "md5")
    per = good.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("md5").alias("k"), F.min("md5").alias("md5"))
    problems = x.where("problem is not null").select(F.col("v").alias("path"), "problem").unionByName(per.where("n > 1").select("path", F.when(F.col("k") > 1, "conflicting_duplicate").otherwise("duplicate_path").alias("problem")))
    return per.where("n = 1").select("path", "md5"), problems


def lenient_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, md5) of lines `md5 path` by the last part of the path, in any case, with an optional * before the path; lines of another
    form say nothing. Of a name that occurs more than once the last line holds."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r$", "")).alias("v"), F.monotonically_increasing_id().alias("o"))
    pattern = r"^([0-9a-fA-F]{32})\s+\*?(\S.*)$"
    x = lines.select("o", F.lower(F.regexp_extract("v", pattern, 1)).alias("md5"), F.regexp_extract("v", pattern, 2).alias("p")).where("md5 <> ''")
    return x.groupBy(F.regexp_extract("p", r"([^/]*)/*$", 1).alias("name")).agg(F.max_by("md5", "o").alias("md5"))


def concatenated_reads(biological: DataFrame, control: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reads, problems) of two tables (id, seq) put together: reads (id, seq, is_control); problems (id, n) of ids that occur more than once."""
    both = biological.select("id", "seq", F.lit(False).alias("is_control")).unionByName(control.select("id", "seq", F.lit(True).alias("is_control")))
    return both, both.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null")


def selected_contigs(contigs: DataFrame, policy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, problems) of contigs (id, seq, ...) against the accessions that a policy keeps (accession, reason, length; reason null:
    kept). problems (accession, problem): `missing`, `repeated` or `length`, where a length is known. Only names and lengths are joined."""
    want = policy.where("reason is null and accession is not null").select("accession", "length").distinct()
    there = contigs.select(F.col("id").alias("accession"), F.length("seq").alias("found")).join(want.select("accession"), "accession", "left_semi")
    per = want.join(there.groupBy("accession").agg(F.count("*").alias("n"), F.max("found").alias("found")), "accession", "left")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when((F.col("length") > 0) & (F.col("length") != F.col("found")), "length")
    kept = contigs.join(want.select(F.col("accession").alias("id")), "id", "left_semi")
    return kept, per.select("accession", problem.alias("problem")).where("problem is not null")


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the lines that are neither blank nor comments."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where((F.col("path") != "") & ~F.col("path").startswith("#"))


def inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size, sha256, md5) of files, each read whole by a task. A missing file raises."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def toml_config(path: str) -> dict:
    """A TOML configuration, on the driver."""
    return tomllib.loads(Path(path).read_text())
