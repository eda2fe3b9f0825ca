"""Column functions on sequences of bases and bits. All stay in the JVM except window_text, which reads messy cells in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.windows import strict_bases, to_text, unpack, windows


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def window_text(records: DataFrame) -> DataFrame:
    """(row_index, seq): each record's window as letters, N where unreadable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_text(unpack(w)) for w in b.column(1).to_pylist()], pa.string())], names=["row_index", "seq"])

    return windows(records).select("row_index", "window").mapInArrow(run, "row_index long, seq string")


def _groups(b: Column) -> Column:
    """A string of bits as hexadecimal digits, one a group of four; sixty bits are converted at a time."""
    piece = F.transform(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1)), F.lit(60)), lambda i: F.lpad(F.conv(F.substr(b, i, F.lit(60)), 2, 16), F.ceil(F.least(F.lit(60), F.length(b) - i + 1) / 4).cast("int"), F.lit("0")))
    return F.array_join(piece, "")


def decode_strict(records: DataFrame, key: str = "row_index", cell: str = "sequence", with_cell: bool = False) -> DataFrame:
    """(key, seq, with_cell the cell too) of the cells that decode_bits decodes and that aren't empty, by matrix operations on Arrow batches: for whole tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out, cells = [], [], []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if c and len(c) % 4 == 0 and c.isascii() and (text := strict_bases(c)) is not None:
                    keys.append(k)
                    out.append(text)
                    cells.append(c)
            cols = [pa.array(keys, pa.int64()), pa.array(out, pa.string()), *([pa.array(cells, pa.string())] if with_cell else [])]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "seq", *([cell] if with_cell else [])])

    src = records.where(F.col(key).isNotNull() & F.col(cell).isNotNull()).select(F.col(key).cast("long").alias(key), cell)
    return src.mapInArrow(run, f"`{key}` long, seq string" + (f", `{cell}` string" if with_cell else ""))


def decode_bits(bits: Column | str) -> Column:
    """Bases of a strict one-hot string in A, C, G, T order; null unless every group of four is one-hot. The empty string stays empty."""
    b = _c(bits)
    text = F.nullif(F.regexp_extract(F.translate(_groups(b), "8421ABCDEF", "ACGTxxxxxx"), r"^[ACGT]+\z", 0), F.lit(""))
    return F.when(F.length(b) == 0, "").when((F.length(b) % 4 == 0) & b.rlike(r"^[01]+\z"), text)


def encode_bases(seq: Column | str) -> Column:
    """The one-hot string of A, C, G and T; null if any other character occurs."""
    s = _c(seq)
    out = s
    for base, bits in (("A", "1000"), ("C", "0100"), ("G", "0010"), ("T", "0001")):
        out = F.replace(out, F.lit(base), F.lit(bits))
    return F.when(s.rlike("^[ACGT]*$"), out)


def is_one_hot(bits: Column | str) -> Column:
    """Whether the cell is a run of one-hot groups and not empty. No pattern repeats a group: that would need stack for each."""
    b = _c(bits)
    return (F.length(b) % 4 == 0) & b.rlike(r"^[01]+\z") & F.when(F.length(b) > 0, _groups(b).rlike(r"^[1248]+\z")).otherwise(False)


def count_of(text: Column, letters: str) -> Column:
    """How many of the letters the text has."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def one_hot_problem(bits: Column | str, length: Column | int) -> Column:
    """Why a cell isn't a one-hot matrix of `length` bases: `length`, `counts` (of ones and zeros), `groups`, or null."""
    b, n = _c(bits), F.lit(length) if isinstance(length, int) else length
    return (
        F.when(b.isNull() | (F.length(b) != n * 4), "length")
        .when((count_of(b, "1") != n) | (count_of(b, "0") != n * 3), "counts")
        .when(~is_one_hot(b), "groups")
    )


def reverse_complement(seq: Column | str) -> Column:
    """Reversed, with A and T, C and G exchanged; other characters stay as they are."""
    return F.reverse(F.translate(_c(seq), "ACGT", "TGCA"))


def gc_fraction(seq: Column | str) -> Column:
    """G and C of either case over the whole length; 0 for the empty sequence."""
    s = _c(seq)
    return F.when(F.length(s) == 0, 0.0).otherwise(count_of(s, "GCgc") / F.length(s))


def center(seq: Column | str, length: int) -> Column:
    """The middle `length` bases; the whole sequence where it is shorter."""
    s = _c(seq)
    return F.when(F.length(s) <= length, s).otherwise(F.substr(s, F.floor((F.length(s) - length) / 2).cast("int") + 1, F.lit(length)))


def entropy(seq: Column | str) -> Column:
    """Shannon entropy in bits of A, C, G, T in either case; other characters are left out, 0 without any."""
    s = _c(seq)
    counts = F.array(*[count_of(s, x + x.lower()).cast("double") for x in "ACGT"])
    # log2(n) - sum(k log2 k) / n, in one pass over the four counts
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("t"))
    step = lambda a, k: F.struct((a["n"] + k).alias("n"), (a["t"] + F.when(k > 0, k * F.log2(k)).otherwise(0.0)).alias("t"))
    return F.aggregate(counts, start, step, lambda a: F.when(a["n"] > 0, F.greatest(F.lit(0.0), F.log2(a["n"]) - a["t"] / a["n"])).otherwise(0.0))


def decile(value: Column | str, most: float) -> Column:
    """0 to 9: the tenth of [0, most] that holds the value, clamped; 0 where most isn't positive."""
    if most <= 0:
        return F.when(_c(value).isNotNull(), F.lit(0))
    return F.least(F.lit(9), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(value) / most)) * 10)).cast("int")


def gc_decile(seq: Column | str) -> Column:
    return decile(gc_fraction(seq), 1.0)


def low_complexity_decile(seq: Column | str) -> Column:
    return decile(entropy(seq), 2.0)


def base_classes(seq: Column | str) -> dict[str, Column]:
    """Upper-case, lower-case and other bases."""
    s = _c(seq)
    up, low = count_of(s, "ACGT"), count_of(s, "acgt")
    return {"upper": up, "lower": low, "other": F.length(s) - up - low}


def dinucleotides(df: DataFrame, seq: str = "seq") -> DataFrame:
    """df with a row per pair of neighbouring bases in the column `pair`."""
    n = F.length(seq)
    return df.where(n > 1).withColumn("i_", F.explode(F.sequence(F.lit(1), n - 1))).withColumn("pair", F.substr(F.col(seq), F.col("i_"), F.lit(2))).drop("i_")
