"""Label counts of records that arrive over time: values are read per micro-batch, redelivered records are dropped, counts are kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.labels import CellParser


def stream_class_counts(records: DataFrame, names: dict[str, int], late: str = "30 days") -> DataFrame:
    """(label_value, n_records) of a stream of records (row_index, labels, loaded_at), for update or complete output.

    A record counts at its first delivery; a delivery that comes over `late` after the first may count again. Rows without a
    row_index or loaded_at are left out.
    """
    once = records.where("row_index is not null and loaded_at is not null").select("row_index", "labels", F.col("loaded_at").cast("timestamp").alias("loaded_at")).withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["row_index"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = CellParser(names)
        for b in batches:
            values = [v for c in b.column("labels").to_pylist() if c for v in sorted({x.value for x in parser.read(c) if x.value is not None})]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int32())], names=["label_value"])

    return once.select("labels").mapInArrow(run, "label_value int").groupBy("label_value").agg(F.count("*").alias("n_records"))
