"""What several operators read from the records: signed values of each, the newest audit, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.labels import label_values

#: Words that stand for no transcript, in lower case.
PLACEHOLDERS = ("", "-", "--", ".", "?", "na", "n/a", "n.a.", "none", "null", "nan", "nil", "unknown", "unk", "not known", "missing", "tbd")


def protein_names(proteins: DataFrame) -> dict[str, int]:
    """Names and ids; a dictionary table of the proteins (122 here), at most 100,000 rows."""
    rows = proteins.where("protein_name is not null and protein_id is not null").select("protein_name", "protein_id").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("proteins is no dictionary table")
    return {r.protein_name: int(r.protein_id) for r in sorted(rows, reverse=True)}


def record_values(records: DataFrame, proteins: DataFrame) -> DataFrame:
    """(row_index, value, is_first): every value of every record, repeated ones too; is_first at a value's first use in the record."""
    return label_values(records, protein_names(proteins)).where("label_value is not null").select("row_index", F.col("label_value").alias("value"), "is_first")


def held_values(records: DataFrame, proteins: DataFrame) -> DataFrame:
    """(row_index, value): each distinct value of each record once."""
    return record_values(records, proteins).where("is_first").select("row_index", "value")


def newest_audit(audit: DataFrame) -> DataFrame:
    """(protein_id, positive_count, negative_count, known_count) of the newest audit, each protein once.

    The newest audit is the one whose first row is latest, as rows of older ones may come late; of several rows of a protein the latest counts, the largest counts on a tie.
    """
    a = audit.where("audited_at is not null and protein_id is not null")
    a = a.where("audit_id is not null")
    begun = a.groupBy("audit_id").agg(F.min("audited_at").alias("begun"))
    last = begun.agg(F.max(F.struct("begun", "audit_id")).alias("m")).select(F.col("m.audit_id").alias("audit_id"))
    rows = a.join(F.broadcast(last), "audit_id")  # one row
    by = Window.partitionBy("protein_id").orderBy(F.desc("audited_at"), F.desc_nulls_last("positive_count"), F.desc_nulls_last("negative_count"), F.desc_nulls_last("known_count"))
    return rows.withColumn("r_", F.row_number().over(by)).where("r_ = 1").select("protein_id", "positive_count", "negative_count", "known_count")


def transcript_key(column: str) -> Column:
    """The transcript without case, surrounding blanks and version; null where none is named."""
    t = F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    t = F.regexp_replace(t, r"\s*\.\d+$", "")
    return F.when(~t.isin(*PLACEHOLDERS), t)
