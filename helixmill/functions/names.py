"""Accessions, listing paths, alignment flags and tolerant casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def na_to_null(x: Column) -> Column:
    """Blank and the text na, in any case, are null."""
    t = F.trim(x)
    return F.when(~F.lower(t).isin("", "na"), t)


def contig_category(unit: Column, role: Column) -> Column:
    """chromosome, mitochondrion, unlocalized or unplaced; null for what isn't part of the primary assembly."""
    u, r = F.trim(unit), F.lower(F.trim(role))
    primary = u == "Primary Assembly"
    return (
        F.when(primary & (r == "assembled-molecule"), "chromosome")
        .when(primary & (r == "unlocalized-scaffold"), "unlocalized")
        .when(primary & (r == "unplaced-scaffold"), "unplaced")
        .when((u == "non-nuclear") & (r == "assembled-molecule"), "mitochondrion")
    )


def selected_accession(*preferred: Column) -> Column:
    """The first usable accession in the order of preference."""
    return F.coalesce(*[na_to_null(p) for p in preferred])


def listing_path(path: Column) -> Column:
    """A checksum listing's path without . and empty segments; null where it is absolute, has a backslash or .., or is empty."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    return F.when(listing_path_problem(path).isNull(), F.array_join(parts, "/"))


def listing_path_problem(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    return F.when(path.isNull() | (F.trim(path) == ""), "empty").when(path.contains("\\"), "backslash").when(path.startswith("/"), "absolute").when(F.array_contains(F.split(path, "/"), ".."), "parent").when(F.size(parts) == 0, "empty")


def expected_listing_path(listing_url: Column, file_url: Column) -> Column:
    """The path of a file relative to its listing's folder; null unless scheme, host and folder agree."""
    base = F.regexp_replace(listing_url, "[^/]*$", "")
    same = (F.parse_url(listing_url, F.lit("HOST")) == F.parse_url(file_url, F.lit("HOST"))) & (F.parse_url(listing_url, F.lit("PROTOCOL")) == F.parse_url(file_url, F.lit("PROTOCOL")))
    return F.when(same & F.startswith(file_url, base), F.substr(file_url, F.length(base) + 1))


def flag_set(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY = 0x4, 0x10, 0x100, 0x800


def is_primary(flag: Column) -> Column:
    return ~flag_set(flag, SECONDARY) & ~flag_set(flag, SUPPLEMENTARY)


def is_truthy(text: Column) -> Column:
    """1, true and yes, in any case, with blanks around."""
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes"), F.lit(False))


def double_or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def int_or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("long")
