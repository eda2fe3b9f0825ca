"""Queries on packed label cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.labels import label_values
from helixmill.plans import sql


def protein_ids(proteins: DataFrame) -> dict[str, int]:
    """Names and ids of the protein dictionary (122 rows; at most 100,000)."""
    rows = proteins.where("protein_name is not null and protein_id is not null").select("protein_name", "protein_id").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("proteins is no dictionary table")
    return {r.protein_name: int(r.protein_id) for r in sorted(rows, reverse=True)}


def packed_values(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/tiny_coordinates_dataset.parquet")
    return label_values(t, protein_ids(spark.read.parquet(f"{d}/proteins.parquet")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packed_values(spark, d).where("label_value is not null").select("row_index", "pos", "label_value")


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    """How many records and slots have each flag; values without one have null."""
    return packed_values(spark, d).groupBy("flag").agg(F.count("*").alias("n_slots"), F.count_distinct("row_index").alias("n_records"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p5_found": p5_found, "p5_flags": p5_flags}


def oracle_sql() -> dict[str, str]:
    # for cells without malformed quotes or unreadable text, of which these tables have none: remarks go by pattern
    return {
        "p5_found": f"with {sql.VAL} select row_index, pos, v label_value from val",
        "p5_flags": f"with {sql.VAL} select cast(null as varchar) flag, count(*) n_slots, count(distinct row_index) n_records from val",
    }
