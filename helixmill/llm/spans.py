"""Long exact spans that records share (problem 1): recurring anchors, sharded Aho-Corasick automata, spans confirmed base by base.

1. Anchors. Of every LENGTH readable bases in a row, the 32-mer of the smallest hash is an anchor. Equal stretches have equal
   anchors, so a span of LENGTH or more that two records share holds an anchor of both. A 32-mer is its own 64-bit key.
2. Anchors that two records or more hold are the recurring passages. They go to shards by the smallest record that holds
   them, which brings the anchors of one span together; a record goes once to each shard of its anchors.
3. A shard's anchors become one automaton, and its records stream through it. Every stretch of LENGTH bases around an
   occurrence is compared with those of the shard's other records: by a hash, then base by base.
4. Anchors of over HOT records are salted: their stretches that no record of the same salt shares are matched by an
   aggregation over all salts, by their bases and not by a hash. Anchors are counted before they are joined back, and the rows
   of the hottest stay where they are for that. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.windows import Windows, mix64, slices, to_text
from helixmill.session import hot_join, hot_keys, materialize

LENGTH = 150
K = 32
#: Hits of one shard, about; records of an anchor that is not salted.
HITS = 8_000
HOT = 8_000


def _slide_min(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of width values."""
    step = 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if width > step else h


def _stretches(w: Windows, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(32-mer by place, whether a stretch of length readable bases starts there); places without one have the value 0."""
    n = len(w.codes)
    bad = np.concatenate([[0], np.cumsum(w.codes == 4)])
    whole = np.zeros(n, bool)
    if n >= length:
        whole[: n - length + 1] = bad[length:] == bad[: n - length + 1]
    v = np.zeros(n, np.uint64)
    at, x = w.kmers(K)
    v[at] = x
    return v, whole


def anchors(windows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(anchor, row_index), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            packed = whole_batch.column("window").to_pylist()
            for lo, hi in slices(packed):
                b = whole_batch.slice(lo, hi - lo)
                w = Windows(packed[lo:hi])
                v, whole = _stretches(w, length)
                if not whole.any():
                    continue
                low = _slide_min(mix64(v, 3), length - K + 1)
                starts = np.flatnonzero(whole[: len(low)])
                rows, h = w.row[starts], low[starts]
                new = np.ones(len(h), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
                rows, h = rows[new], h[new]
                order = np.lexsort((h, rows))
                rows, h = rows[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
                ids = b.column("row_index").to_numpy(zero_copy_only=False)[rows[new]]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(ids)], names=["anchor", "row_index"])

    return windows.select("row_index", "window").mapInArrow(run, "anchor long, row_index long")


def _unmix64(h: np.ndarray, seed: int) -> np.ndarray:
    """The value whose mix64 is h."""
    with np.errstate(over="ignore"):
        h = h.astype(np.uint64)
        h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
        h = h * np.uint64(pow(0x94D049BB133111EB, -1, 2**64))
        h = h ^ (h >> np.uint64(27)) ^ (h >> np.uint64(54))
        h = h * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
        h = h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))
        return h - np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)


def anchor_texts(keys: np.ndarray) -> list[str]:
    v = _unmix64(keys.view(np.uint64), 3)
    codes = (v[:, None] >> np.arange(2 * K - 2, -1, -2, dtype=np.uint64)) & np.uint64(3)
    return [to_text(c) for c in codes.astype(np.uint8)]


def _locate(automaton, ids: np.ndarray, packed: list[bytes], length: int) -> tuple[Windows, np.ndarray, np.ndarray]:
    """(windows, 32-mers, starts): of all stretches of length that hold an occurrence, their places in the windows' codes."""
    w = Windows(packed)
    v, whole = _stretches(w, length)
    near = np.zeros(len(w.codes) + 1, np.int32)
    for r in range(len(packed)):
        base, text = int(w.start[r]), to_text(w.codes[w.start[r] : w.start[r] + w.size[r]])
        for end, _ in automaton.iter(text):
            near[max(base, base + end + 1 - length)] += 1  # stretches that start from here
            near[base + end - K + 2] -= 1  # to the occurrence's own start
    return w, v, np.flatnonzero(whole & (np.cumsum(near[:-1]) > 0))


def _offsets(length: int) -> list[int]:
    """Where 32-mers start that together hold all bases of a stretch."""
    return [*range(0, length - K, K), length - K]


def _stretch_bytes(v: np.ndarray, starts: np.ndarray, length: int) -> pa.Array:
    """The bases of each stretch, packed."""
    raw = np.ascontiguousarray(np.stack([v[starts + o] for o in _offsets(length)], axis=1))
    width = raw.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.arange(len(starts) + 1) * width).astype(np.int32)), pa.py_buffer(raw.tobytes())])


def _equal_groups(v: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The group of equal stretches, by start. Hashes only bring them together, all bases are compared."""
    offsets = _offsets(length)
    h = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for i, o in enumerate(offsets):
            h += mix64(v[starts + o], 20 + i)
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(order), bool)
    s = starts[order]
    same[1:] = h[order[1:]] == h[order[:-1]]
    for o in offsets:
        same[1:] &= v[s[1:] + o] == v[s[:-1] + o]
    if (h[order[1:]] == h[order[:-1]]).sum() != same[1:].sum():  # two stretches of one hash: sort by all bases
        order = np.lexsort([v[starts + o] for o in offsets])
        s = starts[order]
        same = np.zeros(len(order), bool)
        same[1:] = np.all([v[s[1:] + o] == v[s[:-1] + o] for o in offsets], axis=0)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(~same) - 1
    return group


def _intervals(starts: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs that overlapping stretches of one row make; starts and rows come sorted."""
    if not len(starts):
        return row, starts, starts
    new = np.ones(len(starts), bool)
    new[1:] = (row[1:] != row[:-1]) | (starts[1:] > starts[:-1] + length)
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]
    return row[new], starts[new], starts[last] + length


def shared_spans(windows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row_index, start, stop): the places of each record, from 0 and without overlaps, of all runs of at least `length`
    readable bases that stand verbatim in the window of another row_index. Empty and short windows have none."""
    import ahocorasick  # noqa: F401 - fails here, not in a task

    w = materialize(windows.select("row_index", "window"), "windows")
    a = materialize(anchors(w, length), "anchors")
    stats = a.groupBy("anchor").agg(F.count("*").alias("n"), F.min("row_index").alias("first")).where("n > 1")
    hits = materialize(hot_join(a, stats, "anchor", hot_keys(stats, "anchor", a.count())), "hits")
    shards = max(1, -(-hits.count() // HITS))
    salts = F.ceil(F.col("n") / HOT).cast("int")
    placed = hits.select("anchor", "row_index", "n", F.pmod(F.xxhash64("first", F.when(F.col("n") > HOT, F.col("anchor"))), F.lit(shards)).alias("shard"), F.when(F.col("n") > HOT, F.pmod(F.xxhash64("row_index", F.lit(5)), salts)).otherwise(-1).cast("int").alias("salt"), F.when(F.col("n") > HOT, F.col("anchor")).alias("hot"))
    # an automaton's words: for salted anchors one shard per anchor and salt
    words = placed.select("shard", "salt", "hot", "anchor").distinct().select("shard", "salt", "hot", "anchor", F.lit(None).cast("long").alias("row_index"), F.lit(None).cast("binary").alias("window"))
    docs = placed.select("shard", "salt", "hot", "row_index").distinct().join(w, "row_index").select("shard", "salt", "hot", F.lit(None).cast("long").alias("anchor"), "row_index", "window")
    both = words.unionByName(docs).repartition("shard", "salt", "hot").sortWithinPartitions("shard", "salt", "hot", F.col("anchor").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            doc = t["window"].is_valid().to_numpy()
            for text in anchor_texts(t.filter(pa.array(~doc))["anchor"].to_numpy()):
                automaton.add_word(text, 0)
            automaton.make_automaton()
            d = t.filter(pa.array(doc))
            ids = d["row_index"].to_numpy()
            w, v, starts = _locate(automaton, ids, d["window"].to_pylist(), length)
            group = _equal_groups(v, starts, length)
            row = w.row[starts]
            order = np.lexsort((row, group))
            g, r = group[order], row[order]
            n_groups = int(g[-1]) + 1 if len(g) else 0
            low, high = np.full(n_groups, 1 << 62), np.full(n_groups, -1)
            np.minimum.at(low, g, r)
            np.maximum.at(high, g, r)
            shared = (low < high)[group]
            rr, s, e = _intervals(starts[shared], row[shared], length)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rr]), pa.array((s - w.start[rr]).astype(np.int32)), pa.array((e - w.start[rr]).astype(np.int32)), pa.nulls(len(rr), pa.binary())], names=names)
            if t["salt"][0].as_py() >= 0:  # what other salts may share: one row of a shared stretch, and all others
                _, one = np.unique(group[shared], return_index=True)
                open_ = np.r_[np.flatnonzero(shared)[one], np.flatnonzero(~shared)]
                at = starts[open_] - w.start[row[open_]]
                for lo in range(0, len(open_), 100_000):
                    o, x = open_[lo : lo + 100_000], at[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row[o]]), pa.array(x.astype(np.int32)), pa.array((x + length).astype(np.int32)), _stretch_bytes(v, starts[o], length)], names=names)

        names = ["row_index", "start", "stop", "bases"]
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            keys = list(zip(*(b.column(c).to_numpy(zero_copy_only=False).tolist() if c != "hot" else b.column(c).fill_null(0).to_numpy().tolist() for c in ("shard", "salt", "hot"))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if key is not None and keys[lo] != key:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                key = keys[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from work(pa.Table.from_batches(held))

    found = materialize(both.mapInArrow(run, "row_index long, start int, stop int, bases binary"), "spans")
    open_ = found.where("bases is not null")  # of one stretch at most a row a salt
    across = open_.groupBy("bases").agg(F.min("row_index").alias("lo"), F.max("row_index").alias("hi")).where("lo <> hi").select("bases")
    spans = found.where("bases is null").select("row_index", "start", "stop").unionByName(open_.join(across, "bases").select("row_index", "start", "stop"))
    # overlapping spans of one record become one
    listed = spans.groupBy("row_index").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("s"))
    merged = F.expr(
        "aggregate(s, cast(array() as array<struct<start:int,stop:int>>), (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).stop >= x.start,"
        " concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(element_at(acc, -1).stop, x.stop) as stop))), concat(acc, array(x))))"
    )
    return listed.select("row_index", F.explode(merged).alias("x")).select("row_index", "x.start", "x.stop")


def shared_lengths(windows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row_index, n_bases, n_spans, shared_nt, shared_share) of every record; shared_nt counts each base once."""
    w = windows.select("row_index", "window")
    digits = F.hex(F.substring("window", 1, 4))  # the packed length, its low byte first
    n = F.conv(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("int")
    by = shared_spans(w, length).groupBy("row_index").agg(F.count("*").cast("int").alias("n_spans"), F.sum(F.col("stop") - F.col("start")).cast("int").alias("shared_nt"))
    out = w.select("row_index", n.alias("n_bases")).join(by, "row_index", "left")
    return out.select("row_index", "n_bases", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("shared_nt", F.lit(0)).alias("shared_nt"), F.when(F.col("n_bases") > 0, F.coalesce("shared_nt", F.lit(0)) / F.col("n_bases")).alias("shared_share"))
