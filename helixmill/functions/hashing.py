"""Deterministic ranks from SHA-256 over fields joined by the unit separator."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_fields(*fields: Column | str | int) -> Column:
    """Fields as text with U+001F between; a null field is the text None."""
    cols = [F.coalesce((f if isinstance(f, Column) else F.lit(f)).cast("string"), F.lit("None")) for f in fields]
    return F.concat_ws("\x1f", *cols)


def hash_rank(*fields: Column | str | int) -> Column:
    """The first 16 hexadecimal digits; as text it sorts like the unsigned number."""
    return F.substring(F.sha2(encode_fields(*fields), 256), 1, 16)


def content_fingerprint(*fields: Column | str | int) -> Column:
    return F.sha2(encode_fields(*fields), 256)


def label_blind_rank(seed: int, sample_id: Column) -> Column:
    return hash_rank(seed, "label_blind", sample_id)


def quota_rank(seed: int, sample_id: Column, protein_id: Column, label_class: Column) -> Column:
    return hash_rank(seed, sample_id, protein_id, label_class)


def control_seed(seed: int, sample_id: Column, attempt: Column | int) -> Column:
    return hash_rank(seed, "control", sample_id, attempt)


def control_seed_of(seed: int, sample_id: str, attempt: int) -> int:
    """control_seed as a number, for code in Arrow batches."""
    return int(sha256(f"{seed}\x1fcontrol\x1f{sample_id}\x1f{attempt}".encode()).hexdigest()[:16], 16)
