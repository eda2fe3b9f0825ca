"""Sketches of windows for similarity joins, and the shards in which similar windows meet.

The similarity of two windows is the Jaccard index of their sets of readable 8-mers. With sets A and B it is at least t just
when |A xor B| <= (1-t)/(1+t) * (|A|+|B|).

* Code: 1,024 bits, each the parity of the number of distinct 8-mers hashed to it. An 8-mer that only one set holds flips one
  bit, so the Hamming distance of two codes never exceeds |A xor B|: the radius above loses no pair.
* Seeds: for each of BANDS random orders of all 8-mers the three that come first in the set, as one key. Two sets have the
  same key just when the first three of their union are common to both, whatever the windows look like (repeats, unreadable
  bases, rearrangements, unlike lengths). At similarity t that has a probability of about t^3, in each order anew: at 0.6 and
  with 64 orders no key is common with a probability of at most exp(-15), for every pair of sets of over SMALL 8-mers. Sets
  of up to SMALL / 0.6 have a complete filter besides: the first n - ceil(0.6 n) + 1 of n 8-mers in one fixed order, of which
  sets of that similarity always share one, so no pair with a set of up to SMALL is missed. For the other strand the
  reverse complements of one side of the join give their seeds too.
* Shards: the windows that hold one seed. Shards with the same members count once. Those of over HEAVY windows are compared
  block by block, so none is capped and no seed is left out, however frequent. Blocks of one shard make work that grows with
  its square. All windows that stand in a shard of over CROWD therefore get finer seeds instead, the first five in each of
  200 orders: windows that only have a repeat in common rarely share one, similar ones miss each other with a probability of
  exp(-15) again. Of such pairs the shards are the similar windows themselves.
* Hot seeds: those that a sample finds in a fortieth of all windows. Their rows are counted in parts and the parts added up;
  the sample only decides how a seed is counted, each count is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.windows import Windows, complement_kmers, mix64, slices
from helixmill.session import broadcast_if_small, hot_join, materialize

BANDS = 64
HEAVY = 256
#: Members of a shard from which its windows get finer seeds: how many orders, first places and readable 8-mers these take.
CROWD = 32_768
COARSE, FINE = (BANDS, 3, 64), (200, 5, 16)
#: Windows from which hot seeds are looked for, in one of so many windows; parts in which they are counted.
HOT_WINDOWS, HOT_SHARE, ONE_IN, SALTS = 200_000, 40, 64, 256
#: Blocks whose windows are compared with a block's members in one go.
STRIPE = 16
#: Members of one tree or block; what a task holds at a time.
BLOCK = 1024
CHUNK = 8192
CODE_BITS = 1024
SMALL = 64
LOWEST = Fraction(6, 10)  # the similarity for which the complete filter of small sets is made
_BIT = (mix64(np.arange(65536), 11) % np.uint64(CODE_BITS)).astype(np.int64)
_COMPLEMENT8 = complement_kmers(np.arange(65536, dtype=np.uint64), 8).astype(np.int64)


def kmer_sets(w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, values, sizes): the distinct readable 8-mers of each window, sorted by row and value."""
    at, v = w.kmers(8)
    wide = np.uint32 if len(w.size) < 1 << 16 else np.uint64
    key = (w.row[at].astype(wide) << wide(16)) | v.astype(wide)
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new].astype(np.int64)
    rows = key >> 16
    return rows, key & 0xFFFF, np.bincount(rows, minlength=len(w.size))


def codes(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The code of each set as 16 words."""
    odd = np.bincount(rows * CODE_BITS + _BIT[values], minlength=n * CODE_BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, CODE_BITS), axis=1).view(np.uint64)


def complement_set(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = (rows << 16) | _COMPLEMENT8[values]
    key = key.astype(np.uint32 if len(rows) and rows[-1] < 1 << 16 else np.uint64)
    key.sort()
    key = key.astype(np.int64)
    return key >> 16, key & 0xFFFF


@lru_cache(2)
def _orders(bands: int) -> np.ndarray:
    """The place of each 8-mer in each random order."""
    out = np.empty((bands, 65536), np.uint16)
    for i in range(bands):
        out[i, np.argsort(mix64(np.arange(65536), 100 + i))] = np.arange(65536)
    return out


def seeds(rows: np.ndarray, values: np.ndarray, sizes: np.ndarray, level: tuple[int, int, int] = COARSE) -> tuple[np.ndarray, np.ndarray]:
    """(rows, seeds) of the sets. level: orders, first places, and the size up to which sets have no such keys. Keys of three places
    are exact: the number of the order and the places; those of more are hashes, which may bring together what needn't be compared."""
    bands, first_places, small = level
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    large = np.flatnonzero(sizes > small)
    if len(large):
        v, n = values[sizes[rows] > small], sizes[large]
        start, at = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        for band, order in enumerate(_orders(bands)):
            x = order[v]
            key = np.full(len(n), band, np.int64)
            for k in range(first_places):
                low = np.minimum.reduceat(x, start)
                key = (key << 16) | low if first_places <= 3 else mix64(key.view(np.uint64) ^ low.astype(np.uint64), 70 + k).view(np.int64)
                if k < first_places - 1:
                    x[x == low[at]] = 65535  # no set's first ones come that late
            out.append((large, key if first_places <= 3 else key | np.int64(-(2**63))))
    few = (sizes > 0) & (sizes * LOWEST.numerator <= small * LOWEST.denominator)
    if few.any():
        own = few[rows]
        r, x = rows[own], _orders(bands)[0][values[own]].astype(np.int64)
        order = np.lexsort((x, r))
        r, x = r[order], x[order]
        n = np.bincount(r, minlength=len(sizes))
        place = np.arange(len(r)) - (np.cumsum(n) - n)[r]
        first = place < (n + (-n * LOWEST.numerator // LOWEST.denominator) + 1)[r]
        out.append((r[first], (np.int64(bands) << 48) | x[first]))
    return np.concatenate([r for r, _ in out]), np.concatenate([k for _, k in out])


def seed_rows(reps: DataFrame, sides: bool, level: tuple[int, int, int] = COARSE, hot: tuple[int, ...] = ()) -> DataFrame:
    """(id, with sides left and right, seed, salt) of the representatives; with sides those on the right have the seeds of either
    strand. salt is -1, but one of SALTS parts by id for hot seeds."""
    side = ["left", "right"] if sides else []
    src = reps.select("id", *side, "window")
    parts = SALTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.array(sorted(hot), np.int64)
        for whole in batches:
            packed = whole.column("window").to_pylist()
            for lo, hi in slices(packed):
                b = whole.slice(lo, hi - lo)
                rows, values, sizes = kmer_sets(Windows(packed[lo:hi]))
                r, k = seeds(rows, values, sizes, level)
                if sides:
                    turn = b.column("right").to_numpy(zero_copy_only=False)[rows]
                    rows, values = complement_set(rows[turn], values[turn])
                    r2, k2 = seeds(rows, values, np.bincount(rows, minlength=len(sizes)), level)
                    r, k = np.concatenate([r, r2]), np.concatenate([k, k2])
                    order = np.lexsort((k, r))
                    r, k = r[order], k[order]
                    new = np.ones(len(r), bool)
                    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
                    r, k = r[new], k[new]
                at = pa.array(r)
                salt = np.full(len(k), -1, np.int32)
                if len(often):
                    own = np.isin(k, often)
                    salt[own] = mix64(b.column("id").to_numpy()[r[own]].view(np.uint64), 9) % np.uint64(parts)
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("id", *side)], pa.array(k), pa.array(salt)], names=["id", *side, "seed", "salt"])

    return src.mapInArrow(run, "id long, " + "".join(f"{c} boolean, " for c in side) + "seed long, salt int")


def hot_seeds(reps: DataFrame, sides: bool, n: int, level: tuple[int, int, int] = COARSE) -> list[int]:
    """The seeds that are likely held by a share of 1 / HOT_SHARE of the n windows: at most 2 * HOT_SHARE times the seeds of a window."""
    if n <= HOT_WINDOWS:
        return []
    some = reps.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(ONE_IN)) == 0)
    often = seed_rows(some, sides, level).groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= n / HOT_SHARE / ONE_IN)
    return [r.seed for r in often.select("seed").collect()]


def sketch(windows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_index, *keep, window, n8, sig_a, sig_b) of the windows with a readable 8-mer. Equal sets have equal sig_a, sig_b, n8."""
    cols = ["row_index", *keep, "window"]
    src = windows.select(*cols)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            packed = whole.column("window").to_pylist()
            for lo, hi in slices(packed):
                b = whole.slice(lo, hi - lo)
                rows, values, sizes = kmer_sets(Windows(packed[lo:hi]))
                end = np.cumsum(sizes)
                sigs = []
                for s in (1, 2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values, s), dtype=np.uint64)])  # a plain 0 would make it floating
                    sigs.append((total[end] - total[end - sizes]).view(np.int64))
                out = [*b.columns, pa.array(sizes.astype(np.int32)), *[pa.array(x) for x in sigs]]
                yield pa.RecordBatch.from_arrays(out, names=[*cols, "n8", "sig_a", "sig_b"]).filter(pa.array(sizes > 0))

    return src.mapInArrow(run, f"{kinds}, n8 int, sig_a long, sig_b long")


def classes(sketched: DataFrame) -> DataFrame:
    """(row_index, rep) of every record of a class of two or more with equal sets; rep is its smallest row_index."""
    sig = ["sig_a", "sig_b", "n8"]
    several = sketched.groupBy(*sig).agg(F.min("row_index").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    return sketched.select("row_index", *sig).join(broadcast_if_small(several), sig).select("row_index", "rep")


def shards(reps: DataFrame, n: int, sides: bool = False, level: tuple[int, int, int] = COARSE) -> DataFrame:
    """(seed, block, own, id) of the representatives (id, window and, with sides, the booleans left and right), n of them or fewer.

    own: the row is a member of the block; else it only is compared with the members. Shards without two members, and with
    sides those that lack one, are gone; of shards with the same members one stays.
    """
    side = ["left", "right"] if sides else []
    hot = hot_seeds(reps, sides, n, level)
    by = Window.partitionBy("seed", "salt")
    kept = [F.count("*"), F.min("id"), F.expr("bit_xor(xxhash64(id))"), *[F.max(c) for c in side]]
    names = ["cnt", "mn", "fp", *[f"any_{c}" for c in side]]
    shared = seed_rows(reps, sides, level, tuple(hot)).select("seed", "salt", "id", *side, *[a.over(by).alias(c) for a, c in zip(kept, names)])
    shared = shared.where("salt >= 0 or (cnt > 1 and any_left and any_right)" if sides else "salt >= 0 or cnt > 1")
    shared = materialize(shared.select("seed", "salt", "id", *side, *names), "seeds")  # read by several plans
    if hot:
        rare, often = shared.where("salt < 0").select("seed", "id", "cnt", "mn", "fp"), shared.where("salt >= 0")
        total = often.groupBy("seed").agg(*[a.alias(c) for a, c in zip(kept, names)]).where("cnt > 1 and any_left and any_right" if sides else "cnt > 1")
        total = total.select("seed", "cnt", "mn", "fp")
        shared = rare.unionByName(often.select("seed", "id").join(F.broadcast(total), "seed").select(*rare.columns))  # a row a hot seed
    else:
        shared = shared.select("seed", "id", "cnt", "mn", "fp")
    once = shared.where("id = mn").groupBy("cnt", "mn", "fp").agg(F.min("seed").alias("seed")).select("seed")
    rows = hot_join(shared, once, "seed", hot)
    few = rows.where(F.col("cnt") <= HEAVY).select("seed", F.lit(0).cast("long").alias("block"), F.lit(True).alias("own"), "id")
    kept_rows = rows.where(F.col("cnt") > HEAVY)
    finer = None
    if level == COARSE and n > CROWD:  # else no shard can be that large
        crowd = materialize(kept_rows.where(F.col("cnt") > CROWD).select("id").distinct(), "crowd")
        size = crowd.count()
        if size:
            finer = shards(reps.join(crowd, "id", "left_semi"), size, sides, FINE)
            kept_rows = kept_rows.where(F.col("cnt") <= CROWD)
    blocks = F.ceil(F.col("cnt") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("id"), blocks)
    placed = kept_rows.select("seed", "id", own.alias("b"), (blocks - 1).alias("last")).select("seed", "id", "b", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b"))).alias("k"))
    stripe = F.expr(f"explode(if(k = b, sequence(b div {STRIPE}, last div {STRIPE}), array(b div {STRIPE})))")
    many = placed.select("seed", "id", "b", "k", stripe.alias("stripe")).select("seed", (F.shiftleft("k", 24) + F.col("stripe")).alias("block"), (F.col("k") == F.col("b")).alias("own"), "id")
    out = few.unionByName(many)
    return out if finer is None else out.unionByName(finer)


Compare = Callable[["Shard"], tuple[np.ndarray, np.ndarray]]


class Shard:
    """Rows of whole shards, or members and some queries of one: arrays by row."""

    def __init__(self, shard: np.ndarray, own: np.ndarray, ids: np.ndarray, windows: list[bytes], left: np.ndarray, right: np.ndarray):
        self.shard, self.own, self.ids, self.left, self.right = shard, own, ids, left, right
        uniq, self.at = np.unique(ids, return_inverse=True)
        first = np.zeros(len(uniq), np.int64)
        first[self.at[::-1]] = np.arange(len(ids))[::-1]
        own_windows = [windows[i] for i in first]
        parts = [(lo, kmer_sets(Windows(own_windows[lo:hi]))) for lo, hi in slices(own_windows)]
        self.rows = np.concatenate([lo + rows for lo, (rows, _, _) in parts])
        self.values, self.n8 = (np.concatenate([x[i] for _, x in parts]) for i in (1, 2))
        self.code = codes(self.rows, self.values, len(uniq))
        self.end = np.cumsum(self.n8)

    def complement_code(self) -> np.ndarray:
        return codes(*complement_set(self.rows, self.values), len(self.n8))

    def sizes(self) -> np.ndarray:
        return self.n8[self.at]

    def common(self, a: np.ndarray, b: np.ndarray, turned: bool = False) -> np.ndarray:
        """How many 8-mers the sets of rows a[i] and b[i] share; turned: b's reverse complements."""
        out = np.zeros(len(a), np.int64)
        rows, values = complement_set(self.rows, self.values) if turned else (self.rows, self.values)
        for lo in range(0, len(a), 512):
            x, y = self.at[a[lo : lo + 512]], self.at[b[lo : lo + 512]]
            keys = []
            for which, vals in ((x, self.values), (y, values)):
                size = self.n8[which]
                flat = np.arange(size.sum()) + np.repeat(self.end[which] - size - (np.cumsum(size) - size), size)
                keys.append((np.repeat(np.arange(len(which)), size) << 16) | vals[flat])
            key = np.concatenate(keys).astype(np.uint32)  # 512 pairs: 25 bits
            key.sort()
            twice = key[1:][key[1:] == key[:-1]] >> 16
            out[lo : lo + 512] = np.bincount(twice, minlength=len(x))
        return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def radius(na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    """The largest |A xor B| at similarity t, in whole numbers."""
    f = Fraction(t).limit_denominator(10_000)
    return (f.denominator - f.numerator) * (na + nb) // (f.denominator + f.numerator)


def enough(common: np.ndarray, na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    f = Fraction(t).limit_denominator(10_000)
    return common * f.denominator >= f.numerator * (na + nb - common)


def compare_shards(shard_rows: DataFrame, reps: DataFrame, compare: Callable[[Shard], tuple[np.ndarray, np.ndarray, np.ndarray]], sides: bool = False) -> DataFrame:
    """(a, b, similarity) of representatives, a < b, each once: what compare finds in the shards, which come sorted to the tasks."""
    side = ["left", "right"] if sides else []
    carried = shard_rows.join(reps.select("id", "window", *side), "id")
    placed = carried.select(F.col("seed"), "block", "own", "id", "window", *side).repartition("seed", "block").sortWithinPartitions("seed", "block", F.desc("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            seed, block = t["seed"].to_numpy(), t["block"].to_numpy()
            new = np.ones(len(seed), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (block[1:] != block[:-1])
            none = np.ones(len(seed), bool)
            flags = [t[c].to_numpy(zero_copy_only=False) if sides else none for c in ("left", "right")]
            s = Shard(np.cumsum(new) - 1, t["own"].to_numpy(zero_copy_only=False), t["id"].to_numpy(), t["window"].to_pylist(), *flags)
            i, j, sim = compare(s)
            a, b = s.ids[i], s.ids[j]
            key = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), np.round(sim * 1e9).astype(np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(key[0]), pa.array(key[1]), pa.array(key[2] / 1e9)], names=["a", "b", "similarity"])

        held: pa.Table | None = None
        most = CHUNK
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            while held.num_rows > most:
                seed, block = held["seed"].to_numpy(), held["block"].to_numpy()
                cut = np.flatnonzero((seed[1:] != seed[:-1]) | (block[1:] != block[:-1])) + 1
                inside = cut[cut <= most]
                if len(inside):
                    yield from work(held.slice(0, inside[-1]))
                    held = held.slice(inside[-1]).combine_chunks()
                else:  # one shard: its members stay, its queries go by in pieces
                    own = held["own"].to_numpy(zero_copy_only=False)
                    end = int(cut[0]) if len(cut) else held.num_rows
                    members = int(own[:end].sum())
                    if members >= most:  # more members than expected of a block: they are held all the same
                        most = members + CHUNK
                        continue
                    yield from work(held.slice(0, most))
                    held = pa.concat_tables([held.slice(0, members), held.slice(most)]).combine_chunks()
                    if members >= held.num_rows:
                        break
        if held is not None and held.num_rows:
            yield from work(held)

    return placed.mapInArrow(run, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def similar_representatives(windows: DataFrame, compare: Callable, side: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity) of class representatives; members (row_index, rep and the side) of all records with a readable 8-mer.

    side: a column of 'left' and 'right'; only pairs across count.
    """
    keep = (side,) if side else ()
    f = materialize(sketch(windows, keep), "sketch")
    cls = materialize(classes(f), "classes")
    members = f.select("row_index", *keep).join(broadcast_if_small(cls), "row_index", "left").select("row_index", F.coalesce("rep", "row_index").alias("rep"), *keep)
    others = cls.where("row_index <> rep").select("row_index")
    reps = f.join(broadcast_if_small(others), "row_index", "left_anti").withColumnRenamed("row_index", "id")
    if side:
        lr = members.where(F.col("row_index") != F.col("rep")).groupBy(F.col("rep").alias("id")).agg(F.max(F.col(side) == "left").alias("l"), F.max(F.col(side) == "right").alias("r"))
        reps = reps.join(broadcast_if_small(lr), "id", "left").withColumn("left", (F.col(side) == "left") | F.coalesce("l", F.lit(False))).withColumn("right", (F.col(side) == "right") | F.coalesce("r", F.lit(False)))
    return compare_shards(shards(reps, f.count(), side is not None), reps, compare, side is not None), members
