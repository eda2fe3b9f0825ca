"""Reference contigs: category policy, lengths, masking, motifs at introns, clean windows, and exact search on both strands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.hashing import hash_rank
from helixmill.functions.names import contig_category, na_to_null, selected_accession
from helixmill.functions.sequence import base_classes, reverse_complement
from helixmill.functions.windows import mix64
from helixmill.session import materialize

SKIP_MODULUS = 1_000_000
SEED_LENGTH = 32
#: Bases of a contig that are hashed at a time.
PIECE = 1 << 20
BROADCAST_SEEDS = 1_000_000


def apply_policy(report: DataFrame, preference: tuple[str, ...] = ("genbank", "refseq")) -> DataFrame:
    """report with category, accession and reason: null for contigs that are kept, else why they aren't."""
    r = report.withColumn("category", contig_category(F.col("unit"), F.col("role"))).withColumn("accession", selected_accession(*[F.col(p) for p in preference]))
    reason = F.when(F.col("category").isNull(), "outside_policy").when(F.col("accession").isNull(), "source_namespace_unrepresented")
    return r.withColumn("reason", reason).withColumn("raw_accession", F.coalesce(na_to_null(F.col("refseq")), na_to_null(F.col("genbank"))))


def policy_counts(applied: DataFrame) -> DataFrame:
    """(category, reason, n, bases) of kept and excluded contigs."""
    return applied.groupBy("category", "reason").agg(F.count("*").alias("n"), F.sum("length").alias("bases"))


def largest_contig(applied: DataFrame) -> DataFrame:
    """(accession, length) of the longest kept contig, the first accession on a tie."""
    return applied.where("reason is null").orderBy(F.desc("length"), "accession").limit(1).select("accession", "length")


def contig_summary(contigs: DataFrame) -> DataFrame:
    """(id, length, upper, lower, other, masking) of contigs (id, seq)."""
    c = base_classes("seq")
    x = contigs.select("id", F.length("seq").alias("length"), *[v.alias(k) for k, v in c.items()])
    return x.withColumn("masking", F.when(F.col("lower") > 0, "soft").otherwise("unmasked"))


def length_problems(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, problem) where lengths found (id, length) and expected differ: `missing`, `unexpected`, `not_positive`, `length`, `repeated`."""
    f = found.groupBy("id").agg(F.max("length").alias("a"), F.count("*").alias("k"))
    x = f.join(expected.select("id", F.col("length").alias("b")), "id", "full_outer")
    p = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unexpected").when(F.col("k") > 1, "repeated").when(F.col("a") <= 0, "not_positive").when(F.col("a") != F.col("b"), "length")
    return x.select("id", p.alias("problem")).where("problem is not null")


def junction_motif(left: Column, right: Column, strand: Column) -> tuple[Column, Column, Column]:
    """(donor, acceptor, canonical) of an intron's first and last two bases; on the reverse strand turned. canonical is GT..AG, null if unreadable."""
    a, b = F.upper(left), F.upper(right)
    donor = F.when(strand == "-", reverse_complement(b)).otherwise(a)
    acceptor = F.when(strand == "-", reverse_complement(a)).otherwise(b)
    ok = (F.length(donor) == 2) & (F.length(acceptor) == 2)
    return donor, acceptor, F.when(ok, (donor == "GT") & (acceptor == "AG"))


def clean_runs(contigs: DataFrame) -> DataFrame:
    """(id, start, length): the runs of upper-case A, C, G, T of contigs (id, seq), from 0, in one pass over each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = np.zeros(256, bool)
        good[[65, 67, 71, 84]] = True
        for b in batches:
            ids, starts, sizes = [], [], []
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ok = np.concatenate([[False], good[np.frombuffer((s or "").encode("utf-8", "replace"), np.uint8)], [False]])
                edge = np.flatnonzero(ok[1:] != ok[:-1])
                starts += edge[0::2].tolist()
                sizes += (edge[1::2] - edge[0::2]).tolist()
                ids += [i] * (len(edge) // 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["id", "start", "length"])

    return contigs.select(F.col("id").cast("string").alias("id"), "seq").mapInArrow(run, "id string, start long, length long")


def probe_windows(contigs: DataFrame, length: int = 500, modulus: int = SKIP_MODULUS) -> DataFrame:
    """(id, start, stop): one clean window of each contig: the (skip + 1)-th clean start, skip from a hash of id and length; else the first."""
    runs = clean_runs(contigs).where(F.col("length") >= length).withColumn("n", F.col("length") - length + 1)
    size = contigs.select(F.col("id").cast("string").alias("id"), F.length("seq").alias("total"))
    digits = hash_rank(F.col("id"), F.col("total"), "probe_window")
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    skip = F.pmod(F.pmod(high, F.lit(modulus)) * (2**32 % modulus) + low, F.lit(modulus))
    w = Window.partitionBy("id").orderBy("start")
    x = runs.join(size, "id").withColumn("skip", skip).withColumn("before", F.sum("n").over(w) - F.col("n"))
    hit = F.when((F.col("skip") >= F.col("before")) & (F.col("skip") < F.col("before") + F.col("n")), F.col("start") + F.col("skip") - F.col("before"))
    return x.groupBy("id").agg(F.coalesce(F.max(hit), F.min("start")).alias("start")).select("id", "start", (F.col("start") + length).alias("stop"))


def _seed_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the SEED_LENGTH letters from each place on."""
    if len(codes) < SEED_LENGTH:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        v, step = codes.astype(np.uint64) + np.uint64(1), 1
        while step < SEED_LENGTH:
            v = mix64(v[:-step] * np.uint64(3) + v[step:] * np.uint64(5), step)
            step *= 2
    return v.view(np.int64)


def exact_search(patterns: DataFrame, contigs: DataFrame) -> DataFrame:
    """(name, chrom, start, stop, strand): every place of patterns (name, seq) in contigs (id, seq), either strand, any case; a palindrome counts on both.

    Patterns of under SEED_LENGTH bases are refused. The first SEED_LENGTH bases of each pattern and of its reverse complement
    are hashed, and the distinct hashes go to all tasks as a sorted array, at most BROADCAST_SEEDS at a time; with more of them
    contigs are read once for each part. Contigs go by in pieces and send on only the places whose hash is there, with the bases
    that follow, as many as the longest pattern has; so no contig is shuffled or joined. Null contigs hold nothing.
    """
    p = patterns.select("name", F.upper("seq").alias("p"))
    p = p.select("name", F.when(F.length("p") >= SEED_LENGTH, F.col("p")).otherwise(F.raise_error(F.lit(f"a pattern of under {SEED_LENGTH} bases"))).alias("p"))
    both = p.select("name", "p", F.lit("+").alias("strand")).unionByName(p.select("name", reverse_complement("p").alias("p"), F.lit("-").alias("strand")))
    c = contigs.select(F.col("id").cast("string").alias("chrom"), F.upper("seq").alias("s"))

    def run_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [int(_seed_hashes(np.frombuffer(t[:SEED_LENGTH].encode("ascii", "replace"), np.uint8))[0]) for t in b.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("p"), b.column("strand"), pa.array(h, pa.int64())], names=["name", "p", "strand", "h"])

    seeds = materialize(both.mapInArrow(run_patterns, "name string, p string, strand string, h long"), "patterns")
    keys = materialize(seeds.groupBy("h").agg(F.max(F.length("p")).alias("longest")), "seeds")
    n, longest = keys.agg(F.count("*"), F.coalesce(F.max("longest"), F.lit(0))).first()
    parts = max(1, -(-n // BROADCAST_SEEDS))
    spark = patterns.sparkSession
    places = None
    for part in range(parts):
        own = np.sort(keys.where(F.pmod("h", F.lit(parts)) == part).select("h").toArrow()["h"].to_numpy())  # some 8 MB
        found = _places(c, spark.sparkContext.broadcast(own), int(longest))
        places = found if places is None else places.unionByName(found)
    hit = places.join(seeds, "h").where(F.col("tail").startswith(F.col("p")))
    return hit.select("name", "chrom", "start", (F.col("start") + F.length("p")).alias("stop"), "strand").distinct()


def _places(contigs: DataFrame, wanted, longest: int) -> DataFrame:
    """(chrom, start, h, tail): the places of contigs (chrom, s) whose hash is wanted, with the bases from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = wanted.value
        for b in batches if len(w) else ():
            names, text = b.column("chrom"), b.column("s").drop_null().cast(pa.large_string()) if b.column("s").null_count else b.column("s").cast(pa.large_string())
            if b.column("s").null_count:
                names = names.filter(b.column("s").is_valid())
            if not len(text):
                continue
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            if (raw > 127).any():  # places are letters, not bytes
                parts = [t.encode("ascii", "replace") for t in text.to_pylist()]
                ends, raw = np.concatenate([[0], np.cumsum([len(t) for t in parts])]), np.frombuffer(b"".join(parts), np.uint8)
            ends = ends - ends[0]
            for lo in range(0, len(raw), PIECE):
                h = _seed_hashes(raw[lo : lo + PIECE + SEED_LENGTH - 1])
                at = np.flatnonzero(w[np.minimum(np.searchsorted(w, h), len(w) - 1)] == h)
                own = np.searchsorted(ends, at + lo, "right") - 1
                inside = at + lo + SEED_LENGTH <= ends[own + 1]
                at, own = at[inside], own[inside]
                for k in range(0, len(at), 2048):
                    some, of = at[k : k + 2048] + lo, own[k : k + 2048]
                    tails = [raw[i : min(i + longest, e)].tobytes().decode("ascii") for i, e in zip(some.tolist(), ends[of + 1].tolist())]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), pa.array(some - ends[of]), pa.array(h[at[k : k + 2048]]), pa.array(tails, pa.string())], names=["chrom", "start", "h", "tail"])

    return contigs.mapInArrow(run, "chrom string, start long, h long, tail string")


def bed_problems(lines: DataFrame, contig: str, contig_length: int, known: DataFrame) -> DataFrame:
    """(line, problem) of BED lines (line): one row per broken rule. known (name).

    A line of another number of columns, of another contig or without whole positions is looked at no further.
    """
    f = F.split("line", "\t")
    x = lines.where(F.col("line") != "").select("line", f.alias("f"), F.monotonically_increasing_id().alias("ord"))
    col = lambda i: F.try_element_at("f", F.lit(i + 1))
    x = x.withColumn("name", col(3)).join(known.select("name", F.lit(True).alias("known")).distinct(), "name", "left")
    start, stop, score = col(1).try_cast("long"), col(2).try_cast("long"), col(4).try_cast("long")
    x = x.withColumn("start", start).withColumn("stop", stop)
    six, own, whole = F.size("f") == 6, col(0) == contig, start.isNotNull() & stop.isNotNull()
    w = Window.partitionBy("name", "start", "stop", col(5)).orderBy("ord")
    x = x.withColumn("nth", F.when(six & own & whole, F.row_number().over(w)))
    on = six & own
    rules = F.array(
        F.when(~six, "columns"),
        F.when(six & ~own, "contig"),
        F.when(on & F.col("known").isNull(), "unknown_pattern"),
        F.when(on & ~whole, "positions"),
        F.when(on & whole & ~((start >= 0) & (start < stop) & (stop <= contig_length)), "bounds"),
        F.when(on & whole & score.isNull(), "score_not_whole"),
        F.when(on & whole & (score < 0), "score_negative"),
        F.when(on & whole & ~col(5).isin("+", "-"), "strand"),
        F.when(F.col("nth") > 1, "repeated"),
    )
    return x.select("line", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("problem"))


def projection(largest: int, total: int, wall_seconds: float, output_bytes: float, peak_rss_kib: float, hits: int, ram_gib: float | None, free_gib: float | None, allowance: float) -> dict:
    """What a probe of the largest contig projects to all bases: time by 1.5 under 4.5 hours, output by 2 within the allowance, peak
    memory and 2 GiB within both memories. An unknown memory fails."""
    if largest <= 0 or total < largest:
        raise ValueError("lengths must be positive and the total no less than the largest")
    scale = total / largest
    peak = peak_rss_kib * 1024 / 2**30 + 2
    out = {"scale": scale, "wall_seconds": wall_seconds * scale * 1.5, "output_bytes": output_bytes * scale * 2, "peak_gib": peak, "no_hits": hits == 0}
    out["wall_ok"] = out["wall_seconds"] < 4.5 * 3600
    out["output_ok"] = out["output_bytes"] <= allowance
    out["memory_ok"] = ram_gib is not None and free_gib is not None and peak <= min(ram_gib, free_gib)
    return out
