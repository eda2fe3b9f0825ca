"""Windows of bases read from cells of bits or letters, in Arrow batches.

A base is the code 0 to 3 (A, C, G, T) or BAD (unreadable). A window travels packed: its length and the number and places of
unreadable bases as little-endian uint32, then two bits a base. A null cell, a blank cell and a cell without a whole group
are the empty window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAD = 4
_GROUP = np.full(256, BAD, np.uint8)  # by the bits of a group
_GROUP[[8, 4, 2, 1]] = [0, 1, 2, 3]
_LETTER = np.full(256, BAD, np.uint8)
for _i, _c in enumerate("ACGT"):
    _LETTER[[ord(_c), ord(_c.lower())]] = _i
_LETTER[[ord("U"), ord("u")]] = 3
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_QUAD = np.array([[(b >> s) & 3 for s in (6, 4, 2, 0)] for b in range(256)], np.uint8)
_WIDTH = {4: np.uint8, 8: np.uint8, 16: np.uint16, 32: np.uint32, 64: np.uint64}
_TEXT = np.frombuffer(b"ACGTN", np.uint8)


def read_cell(cell: str | None) -> np.ndarray:
    """The base codes of one cell. A cell that holds a 0 or 1 is read as bits, else as letters; anything else in a group or place is unreadable."""
    if not cell:
        return np.zeros(0, np.uint8)
    if not cell.isascii():
        cell = "".join("?" if ord(c) > 127 else c for c in cell if not c.isspace())
    raw = np.frombuffer(cell.encode(), np.uint8)
    raw = raw[~_SPACE[raw]]
    if not ((raw == 48) | (raw == 49)).any():
        return _LETTER[raw]
    g = raw[: len(raw) // 4 * 4].reshape(-1, 4).astype(np.int16) - 48
    g = np.where((g == 0) | (g == 1), g, 16)
    return _GROUP[np.minimum(g @ np.array([8, 4, 2, 1], np.int16), 255)]


def strict_bases(cell: str) -> str | None:
    """The letters of a cell of one-hot groups and nothing else; else null. The cell's length is a multiple of four."""
    g = np.frombuffer(cell.encode(), np.uint8).reshape(-1, 4) - 48
    if g.max(initial=0) > 1:
        return None
    codes = _GROUP[(g[:, 0] << 3) | (g[:, 1] << 2) | (g[:, 2] << 1) | g[:, 3]]
    return None if (codes == BAD).any() else to_text(codes)


def pack(codes: np.ndarray) -> bytes:
    bad = np.flatnonzero(codes == BAD).astype("<u4")
    c = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    c[: len(codes)] = codes & 3  # unreadable bases are 0 here
    q = c.reshape(-1, 4)
    body = (q[:, 0] << 6) | (q[:, 1] << 4) | (q[:, 2] << 2) | q[:, 3]
    return np.array([len(codes), len(bad)], "<u4").tobytes() + bad.tobytes() + body.astype(np.uint8).tobytes()


def unpack(window: bytes | None) -> np.ndarray:
    if not window:
        return np.zeros(0, np.uint8)
    n, k = np.frombuffer(window, "<u4", 2)
    codes = _QUAD[np.frombuffer(window, np.uint8, offset=8 + 4 * int(k))].reshape(-1)[: int(n)]
    if k:
        codes = codes.copy()
        codes[np.frombuffer(window, "<u4", int(k), 8)] = BAD
    return codes


def to_text(codes: np.ndarray) -> str:
    return _TEXT[codes].tobytes().decode()


def reverse_complement(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == BAD, BAD, 3 - codes)[::-1].astype(np.uint8)


def pack_cells(cells: pa.Array) -> pa.Array:
    """Packed windows of an Arrow array of cells; cells of 4n plain bits of the commonest length go through one matrix."""
    cells = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
    n = len(cells)
    out: list[bytes | None] = [None] * n
    if n == 0:
        return pa.array(out, pa.binary())
    wide = pa.types.is_large_string(cells.type)
    off = np.frombuffer(cells.buffers()[1], np.int64 if wide else np.int32)[cells.offset : cells.offset + n + 1].astype(np.int64)
    size = np.diff(off)
    if cells.null_count:
        size[np.asarray(cells.is_null())] = 0
    data = np.frombuffer(cells.buffers()[2] or b"", np.uint8)
    usual = size[(size % 4 == 0) & (size < 1 << 16)]
    common = int(np.bincount(usual).argmax()) if len(usual) else 0
    step = max(1, (1 << 24) // max(1, common))  # some 16 MB of bits at a time
    for lo in range(0, n if common else 0, step):
        own = size[lo : lo + step] == common
        rows = lo + np.flatnonzero(own)
        m = data[off[lo] : off[min(lo + step, n)]][np.repeat(own, np.diff(off[lo : min(lo + step, n) + 1]))].reshape(-1, common) - 48
        plain = (m <= 1).all(1)
        rows, m = rows[plain], m[plain]
        if len(rows):
            g = m.reshape(-1, 4)
            codes = _GROUP[(g[:, 0] << 3) | (g[:, 1] << 2) | (g[:, 2] << 1) | g[:, 3]].reshape(len(rows), -1)
            whole = (codes != BAD).all(1)
            length = codes.shape[1]
            c = np.zeros((len(rows), -(-length // 4) * 4), np.uint8)
            c[:, :length] = codes & 3
            body = (c[:, 0::4] << 6) | (c[:, 1::4] << 4) | (c[:, 2::4] << 2) | c[:, 3::4]
            head = np.array([length, 0], "<u4").tobytes()
            for j, r in enumerate(rows.tolist()):
                out[r] = head + body[j].tobytes() if whole[j] else pack(codes[j])
    for r in range(n):
        if out[r] is None:
            out[r] = pack(read_cell(cells[r].as_py()))
    return pa.array(out, pa.binary())


class Windows:
    """A batch of packed windows as one run of codes, each window followed by an unreadable base, so that no k-mer spans two."""

    def __init__(self, windows: list[bytes]):
        parts, end = [], np.full(1, BAD, np.uint8)
        for w in windows:
            parts += (unpack(w), end)
        self.codes = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        self.size = np.array([len(p) for p in parts[0::2]], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size + 1)[:-1]]).astype(np.int64) if parts else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(windows)), self.size + 1)

    def kmers(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, values) of all readable k-mers, k a power of two up to 32; a value has two bits a base."""
        v, ok, step = self.codes & np.uint8(3), self.codes != BAD, 1
        while step < k:
            if len(v) <= step:
                return np.zeros(0, np.int64), np.zeros(0, np.uint64)
            wide = _WIDTH[min(4 * step, 64)]  # no wider than the value needs
            v = v.astype(wide, copy=False)
            v = (v[:-step] << wide(2 * step)) | v[step:]
            ok = ok[:-step] & ok[step:]
            step *= 2
        at = np.flatnonzero(ok)
        return at, v[at].astype(np.uint64)


def complement_kmers(v: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of k-mers, k a power of two up to 32."""
    v = ~v.astype(np.uint64)
    for s, m in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        v = ((v >> np.uint64(s)) & np.uint64(m)) | ((v & np.uint64(m)) << np.uint64(s))
    v = (v >> np.uint64(32)) | (v << np.uint64(32))
    return v >> np.uint64(64 - 2 * k)


def mix64(v: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (xor, shift and multiply) over uint64."""
    with np.errstate(over="ignore"):
        v = v.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))


def slices(windows: list[bytes], rows: int = 2048, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of a batch of packed windows, of at most so many rows and about so many bytes (four bases each), so that long ones don't fill memory."""
    lo, held = 0, 0
    for i, w in enumerate(windows):
        if i > lo and (i - lo >= rows or held + len(w or b"") > size):
            yield lo, i
            lo, held = i, 0
        held += len(w or b"")
    if lo < len(windows):
        yield lo, len(windows)


def windows(df: DataFrame, key: str = "row_index", cell: str = "sequence", loaded: str | None = "loaded_at") -> DataFrame:
    """(key, window, length): the packed window of each record, once.

    Of several deliveries of a record the first loaded counts (the smaller window on a tie). Rows without a key name no
    record and are left out. Cells are read to packed windows (an eighth of the bits) before the shuffle by key.
    """
    with_time = loaded is not None and loaded in df.columns
    src = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), (F.col(loaded) if with_time else F.lit(None)).cast("timestamp").alias("t"), F.col(cell).cast("string").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = pack_cells(b.column("c"))
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("t"), w], names=["k", "t", "w"])

    packed = src.mapInArrow(run, "k long, t timestamp, w binary")
    one = packed.groupBy("k").agg(F.min(F.struct("t", "w")).alias("m"))
    return one.select(F.col("k").alias(key), F.col("m.w").alias("window"))
