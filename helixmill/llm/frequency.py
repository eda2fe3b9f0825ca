"""Frequency of every value or term (problem 4), heavy and light ones apart.

Values that a first pass finds in over a share of the rows are heavy: each task counts them in a local array of counters,
exact, and passes on one row a value. Only the other values are shuffled, after a count by batch. Then the two tables are united.

Values are whole numbers or strings. In how many records a value occurs is counted by the rows that stand for its first use in a
record: the readers mark them, whatever splits the rows are then read in; else they are found by a shuffle on record and value.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A value is heavy from this share of the rows in a task's sketch; so at most as many values as its inverse from each task.
HEAVY_SHARE = 0.002
#: At most so many heavy values are broadcast; the most frequent of the sketches. All others are light.
HEAVY_VALUES = 10_000
#: A string of more characters is never heavy, so that the broadcast has a bound.
HEAVY_CHARS = 200
RARE_RECORDS = 2
COMMON_SHARE = 0.05
WORD = re.compile("[A-Za-z]+")


def document_terms(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, value, occ, is_first): each word of ASCII letters of a text, in lower case, once with its number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                counts = [Counter(w.lower() for w in WORD.findall(t or "")) for t in part.column(1).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
                value, occ = pa.array([w for c in counts for w in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), value, occ, pa.array(np.ones(len(at), bool))], names=[key, "value", "occ", "is_first"])

    return documents.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text_")).where(f"`{key}` is not null").mapInArrow(run, f"`{key}` long, value string, occ long, is_first boolean")


def _rows(values: DataFrame, key: str) -> tuple[DataFrame, T.DataType]:
    """(value, occ, rec) and the type of value; null values and rows without a record are left out."""
    v = values.where(F.col("value").isNotNull() & F.col(key).isNotNull())
    kind = T.StringType() if isinstance(values.schema["value"].dataType, T.StringType) else T.LongType()
    v = v.select(F.col(key).alias("k_"), F.col("value").cast(kind).alias("value"), (F.col("occ") if "occ" in values.columns else F.lit(1)).cast("long").alias("occ"), *([F.col("is_first")] if "is_first" in values.columns else []))
    if "is_first" not in values.columns:
        v = v.groupBy("k_", "value").agg(F.sum("occ").alias("occ")).withColumn("is_first", F.lit(True))
    return v.select("value", "occ", F.col("is_first").cast("long").alias("rec")), kind


def _heavy(rows: DataFrame, kind: T.DataType, share: float) -> list:
    size = int(2 / share)
    string = isinstance(kind, T.StringType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        seen = 0
        for b in batches:
            enc = b.column("value").dictionary_encode()
            n = np.bincount(enc.indices.to_numpy(), weights=b.column("occ").to_numpy(), minlength=len(enc.dictionary))
            seen += int(n.sum())
            for x, k in zip(enc.dictionary.to_pylist(), n.astype(np.int64).tolist()):
                if not string or len(x) <= HEAVY_CHARS:
                    kept[x] = kept.get(x, 0) + k
            if len(kept) > size:
                cut = sorted(kept.values(), reverse=True)[size]
                kept = {x: k - cut for x, k in kept.items() if k > cut}
        top = {x: k for x, k in kept.items() if k > share * seen}
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.string() if string else pa.int64()), pa.array(list(top.values()), pa.int64())], names=["value", "n"])

    sketch = rows.select("value", "occ").mapInArrow(run, f"value {kind.simpleString()}, n long")
    top = sketch.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(HEAVY_VALUES)
    return sorted(r.value for r in top.collect())


def heavy_values(values: DataFrame, share: float | None = None, key: str = "row_index") -> list:
    """Values with a Misra-Gries count over the share in some task. A miss or an excess costs time only: counts are exact either way."""
    return _heavy(*_rows(values, key), share or HEAVY_SHARE)


def value_counts(values: DataFrame, key: str = "row_index") -> DataFrame:
    """(value, n_occurrences, n_records) of values (key, value; where given, occ: how often, and is_first: whether the row is the
    first of its value in the record). Repeated rows count as occurrences; an empty table gives none."""
    rows, kind = _rows(values, key)
    heavy = values.sparkSession.sparkContext.broadcast(_heavy(rows, kind, HEAVY_SHARE))
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hv = pa.array(heavy.value, arrow)
        occ, rec = np.zeros(len(hv), np.int64), np.zeros(len(hv), np.int64)
        for b in batches:
            enc = b.column("value").dictionary_encode()
            code, d = enc.indices.to_numpy(), enc.dictionary
            o, r = (np.bincount(code, weights=b.column(c).to_numpy(), minlength=len(d)).astype(np.int64) for c in ("occ", "rec"))
            at = pc.fill_null(pc.index_in(d, value_set=hv), -1).to_numpy()
            own = at >= 0
            occ[at[own]] += o[own]
            rec[at[own]] += r[own]
            yield pa.RecordBatch.from_arrays([d.filter(pa.array(~own)), pa.array(o[~own]), pa.array(r[~own])], names=names)
        got = occ > 0
        yield pa.RecordBatch.from_arrays([hv.filter(pa.array(got)), pa.array(occ[got]), pa.array(rec[got])], names=names)

    names = ["value", "occ", "rec"]
    both = rows.mapInArrow(run, f"value {kind.simpleString()}, occ long, rec long")  # the counters of heavy values and the counts of light ones
    return both.groupBy("value").agg(F.sum("occ").alias("n_occurrences"), F.sum("rec").alias("n_records"))


def marked_counts(values: DataFrame, n_records: int, rare: int = RARE_RECORDS, common: float = COMMON_SHARE, key: str = "row_index") -> DataFrame:
    """value_counts with mark: `rare` if at most `rare` records hold the value, `common` if over that share of all records do, else null.
    A value that is both is rare."""
    return value_counts(values, key).withColumn("mark", F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > F.lit(common) * F.lit(n_records), "common"))
