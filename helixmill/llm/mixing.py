"""A mixture of sources by target weights (problem 9), by systematic sampling over prefix sums of expected copies.

Source s is to have target_weight of a whole size T in tokens. Each of its documents is expected in
c = min(max_repeats, target_weight * T / tokens of s) copies. Along an order of the documents, the sums of c plus one random
offset a source cross whole numbers; a document is emitted once for each whole number crossed in it, so floor(c) or ceil(c)
times, never over max_repeats. T is, by mode:

* `shares`: the largest size, at most that of all documents, at which no source with documents needs more than max_repeats.
  Every such source then has its share.
* `whole`: the size of all documents. Sources that can't reach their part stay below it, so those of the others are larger.

The prefix sums are of two levels: buckets of some thousand documents by hash within a source, and the documents of a bucket,
the small ones first, so that the tokens drawn come near c times those of the bucket. So a source with most of the rows is
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.tokenize import VOCABULARY, token_counts
from helixmill.session import materialize

SEED = 20260925
BUCKET = 4096


def source_key(column: str):
    """Sources compare without case and surrounding blanks."""
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def sized_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source_key, n_tokens), written once. Rows without a doc_id are left out; of repeated ids the longest text counts."""
    d = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), source_key("source").alias("source_key"), "text")
    counted = token_counts(d, ["doc_id", "source_key"], vocabulary)
    return materialize(counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source_key")).alias("m")).select("doc_id", "m.source_key", "m.n_tokens"), "sizes")


def plan(sizes: DataFrame, targets: DataFrame, mode: str = "shares") -> DataFrame:
    """One row per source of targets: source (as spelt there), key, weight, max_repeats, tokens, documents, largest (tokens of its
    largest document), all_tokens, whole (T), need, copies (expected of each document) and capped (max_repeats times its tokens
    is less than its weight of all tokens). Targets without a source or weight are left out; of sources that compare equal the
    weights add up and the smallest max_repeats holds."""
    t = targets.where("source is not null and target_weight is not null").withColumn("key", source_key("source"))
    t = t.groupBy("key").agg(F.min("source").alias("source"), F.sum("target_weight").alias("weight"), F.coalesce(F.min("max_repeats"), F.lit(1)).alias("max_repeats"))
    per = sizes.groupBy("source_key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.max("n_tokens").alias("largest"))
    total = per.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    p = t.join(per, t.key == per.source_key, "left").drop("source_key").fillna(0, ["tokens", "documents", "largest"]).join(F.broadcast(total))  # one row
    most = F.col("max_repeats") * F.col("tokens")
    p = p.withColumn("capped", most < F.col("weight") * F.col("all_tokens"))
    fits = F.min(F.when((most > 0) & (F.col("weight") > 0), most / F.col("weight"))).over(Window.partitionBy())  # a row per target
    all_ = F.col("all_tokens").cast("double")
    p = p.withColumn("whole", F.least(all_, F.coalesce(fits, all_)) if mode == "shares" else all_)
    need = F.col("weight") * F.col("whole")
    return p.withColumn("need", need).withColumn("copies", F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("need") / F.col("tokens"))).otherwise(0.0))


def draw(sizes: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents of the mixture, copies at least 1."""
    # the plan has as many rows as targets, a table of configuration
    d = sizes.join(F.broadcast(planned.select("key", "source", F.col("copies").alias("c"), "documents")), F.col("source_key") == F.col("key")).where("c > 0")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    d = d.withColumn("h", h).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.ceil(F.col("documents") / BUCKET)))
    counts = d.groupBy("key", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("key", "bucket", "before")
    offset = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("key")), F.lit(1 << 30)) / float(1 << 30)
    at = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("n_tokens", "h", "doc_id")) + F.col("before")
    d = d.join(before, ["key", "bucket"]).withColumn("at", at).withColumn("u", offset)
    n = F.floor(F.col("at") * F.col("c") + F.col("u")) - F.floor((F.col("at") - 1) * F.col("c") + F.col("u"))
    return d.withColumn("copies", n.cast("int")).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED, mode: str = "shares") -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the mixture. Documents of sources without a target aren't in it."""
    sizes = sized_documents(documents, vocabulary)
    return draw(sizes, plan(sizes, targets, mode), seed)


def report(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """(mode, source, target_weight, max_repeats, n_documents, source_tokens, largest, need, drawn_tokens, most_copies, actual_share,
    capped) of every target, for both modes. capped: the source can't have its weight of all tokens within max_repeats."""
    sizes = sized_documents(documents, vocabulary)
    out = []
    for mode in ("shares", "whole"):
        p = plan(sizes, targets, mode)
        got = draw(sizes, p, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn"), F.max("copies").alias("most"))
        x = p.join(got, "source", "left").withColumn("drawn_tokens", F.coalesce("drawn", F.lit(0))).withColumn("most_copies", F.coalesce("most", F.lit(0)))
        total = F.sum("drawn_tokens").over(Window.partitionBy())  # a row per target
        out.append(x.select(F.lit(mode).alias("mode"), "source", F.col("weight").alias("target_weight"), "max_repeats", F.col("documents").alias("n_documents"), F.col("tokens").alias("source_tokens"), "largest", "need", "drawn_tokens", "most_copies", F.when(total > 0, F.col("drawn_tokens") / total).alias("actual_share"), "capped"))
    return out[0].unionByName(out[1])


def capped_sources(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """(source): the sources of targets that can't reach their weight of all tokens within max_repeats: those of which the mixture
    of the whole size holds every document max_repeats times and still less than they need."""
    r = report(documents, targets, vocabulary, seed).where("mode = 'whole'")
    return r.where((F.col("drawn_tokens") == F.col("max_repeats") * F.col("source_tokens")) & (F.col("drawn_tokens") < F.col("need"))).select("source")


def share_checks(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """(source, share_ok, repeats_ok) of the mixture that keeps the shares: the tokens drawn of a source with documents lie within
    twice its largest document (times its buckets) of its need, and no document comes more than max_repeats times."""
    r = report(documents, targets, vocabulary, seed).where("mode = 'shares'")
    near = 2 * F.col("largest") * F.greatest(F.lit(1), F.ceil(F.col("n_documents") / BUCKET))
    ok = (F.abs(F.col("drawn_tokens") - F.col("need")) <= near) | (F.col("source_tokens") == 0)
    return r.select("source", ok.alias("share_ok"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_ok"))
