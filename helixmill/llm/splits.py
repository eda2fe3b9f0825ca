"""Splits that keep related records together (problem 3): components, their label vectors, rarest outstanding label first.

Records are tied by a transcript or by an equal window on either strand; ties chain. Transcripts are contracted first, so
that only windows which several transcripts' groups hold are edges of the component search.

Placement is grouped iterative stratification in buckets of some ten thousand groups. All groups whose rarest class has at
most HOME records stand in the bucket of that class, the others in buckets by hash. In a bucket the class with the fewest
records left comes first; each of its groups goes whole to the split that lacks most: the records of the group's classes that the
split needs beyond its share of those left, summed over the classes, and what it lacks of all records, up to a bound, as small
classes are to follow it and large ones aren't. Needs and room are brought up to date after each group. A class of at most HOME records has its whole minimum to fill in its own bucket, all else is split by the shares. Groups without
a value come last and fill what room is left. Every distinct value is a class, whatever number it is; totals of the classes
stay in tables. To the driver come only the few groups that are large against a split, and records by split.

A minimum is feasible for a class if it has as many records as all minima together, even without its largest group. Classes
without it follow the shares.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.labels import first_delivery
from helixmill.functions.windows import pack, reverse_complement, unpack, windows
from helixmill.llm.records import held_values, transcript_key
from helixmill.operators.components import components
from helixmill.session import hot_join, hot_keys, materialize

BUCKET = 40_000
#: A class of at most so many records has a bucket of its own groups.
HOME = 5_000
#: A group of over this share of the smallest split is placed by the driver: at most some hundreds can be.
GIANT_SHARE = 0.05
#: A split that lacks so many records of its share counts like one that lacks ROOM_WEIGHT records of a class, and more lacking records no more.
ROOM_STEP, ROOM_WEIGHT = 15, 1.5
#: A class of so many records keeps its shares within 3 points (split_checks).
LARGE_CLASS = 300


def window_keys(w: DataFrame) -> DataFrame:
    """(row_index, key): a 128-bit hash of each window that isn't empty, the same for its reverse complement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for x in b.column("window").to_pylist():
                c = unpack(x)
                keys.append(blake2b(min(pack(c), pack(reverse_complement(c))), digest_size=16).digest() if len(c) else None)
            yield pa.RecordBatch.from_arrays([b.column("row_index"), pa.array(keys, pa.binary())], names=["row_index", "key"])

    return w.select("row_index", "window").mapInArrow(run, "row_index long, key binary").where("key is not null")


def record_groups(records: DataFrame) -> DataFrame:
    """(row_index, group_row_index) of every record; a record without ties is its own group."""
    named = materialize(first_delivery(records, "row_index", ["transcript_id"]).select("row_index", transcript_key("transcript_id").alias("t")), "transcripts")
    several = named.where("t is not null").groupBy("t").agg(F.min("row_index").alias("m"), F.count("*").alias("n")).where("n > 1")
    hot = hot_keys(several, "t", named.count())
    tied = hot_join(named.where("t is not null"), several.select("t", "m"), "t", hot, "left").select("row_index", F.coalesce("m", "row_index").alias("node"))
    node = materialize(tied.unionByName(named.where("t is null").select("row_index", F.col("row_index").alias("node"))), "nodes")
    keyed = materialize(window_keys(windows(records)).join(node, "row_index").select("key", "node"), "keys")
    low = keyed.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    edges = hot_join(keyed, low.select("key", "low"), "key", hot_keys(low, "key", keyed.count())).where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    comp = components(edges)
    crowd = [] if not hot else [r.m for r in several.where(F.col("t").isin(hot)).select("m").collect()]
    return hot_join(node, comp, "node", crowd, "left").select("row_index", F.coalesce("component", "node").alias("group_row_index"))


class Placer:
    """Places the groups of one bucket."""

    def __init__(self, names: list[str], shares: np.ndarray, least: np.ndarray, room: np.ndarray):
        self.names, self.shares, self.least, self.room = names, shares.tolist(), least.tolist(), np.maximum(room, 0)
        self.splits = range(len(names))

    def labelled(self, t: pa.Table) -> pa.Table:
        """Groups with classes (c, n: records of it in the group, total: of it in all, floor: whether its minima are to be filled here, got: what large groups brought)."""
        shares, splits = self.shares, self.splits
        ids, h, size = (t[c].to_numpy() for c in ("group_row_index", "h", "n_records"))
        order = np.lexsort((ids, h))
        ids, size = ids[order], size[order].tolist()
        vectors = [t["classes"][i].as_py() for i in order.tolist()]
        members: dict[int, list[int]] = {}
        left: dict[int, float] = {}
        floor: dict[int, list[float]] = {}
        at: list[dict[int, int]] = []
        for i, v in enumerate(vectors):
            at.append({x["c"]: x["n"] for x in v})
            for x in v:
                c = x["c"]
                members.setdefault(c, []).append(i)
                left[c] = left.get(c, 0) + x["n"]
                if c not in floor:
                    floor[c] = [max(0.0, m - (x["got"][s] if x["got"] else 0)) if x["floor"] else 0.0 for s, m in enumerate(self.least)]
        need = {c: self._need(left[c], floor[c]) for c in left}
        got = {c: [0.0] * len(splits) for c in left}
        whole = float(sum(size))
        space = (self.room / self.room.sum() * whole).tolist() if self.room.sum() > 0 else [s * whole for s in shares]
        out = [-1] * len(ids)
        queue = [(n, c) for c, n in left.items()]
        heapq.heapify(queue)
        while queue:
            n, c = heapq.heappop(queue)
            if left[c] != n:
                if left[c] > 0:
                    heapq.heappush(queue, (left[c], c))
                continue
            for i in sorted((i for i in members[c] if out[i] < 0), key=lambda i: -at[i][c]):
                best, most = 0, -1e300
                for s in splits:
                    p = shares[s]
                    z = size[i] * min(max((space[s] - p * whole) / ROOM_STEP, -1.0), 1.0) * ROOM_WEIGHT
                    for k, m in at[i].items():
                        z += m * (need[k][s] - p * left[k])
                    if z > most + 1e-9:
                        best, most = s, z
                out[i] = best
                space[best] -= size[i]
                whole -= size[i]
                for k, m in at[i].items():
                    need[k][best] -= m
                    got[k][best] += m
                    left[k] -= m
        self._mend(out, at, members, floor, got)
        return self._table(ids, out)

    def _need(self, total: float, floor: list[float]) -> list[float]:
        need = [max(p * total, f) if sum(floor) <= total else p * total for p, f in zip(self.shares, floor)]
        spare = [max(0.0, x - f) for x, f in zip(need, floor)]
        over = sum(need) - total
        if over > 0 and sum(spare) > 0:  # what minima take beyond the shares comes from the splits that have more than theirs
            need = [x - over * s / sum(spare) for x, s in zip(need, spare)]
        return need

    def _mend(self, out: list[int], at: list[dict[int, int]], members: dict[int, list[int]], floor: dict[int, list[float]], got: dict[int, list[float]]) -> None:
        """Moves groups, those of fewest classes first, to splits that still lack records of a minimum, as long as no other minimum breaks."""
        for c in sorted(floor):
            if sum(got[c]) < sum(floor[c]):
                continue
            for s in self.splits:
                if got[c][s] >= floor[c][s]:
                    continue
                for i in sorted((i for i in members[c] if out[i] != s), key=lambda i: (len(at[i]), sum(at[i].values()))):
                    a = out[i]
                    if all(got[k][a] - m >= floor[k][a] for k, m in at[i].items()):
                        out[i] = s
                        for k, m in at[i].items():
                            got[k][a] -= m
                            got[k][s] += m
                        if got[c][s] >= floor[c][s]:
                            break

    def rest(self, t: pa.Table) -> pa.Table:
        """Groups without a class: the largest first, each to the split with most of its room left."""
        ids, h, size = (t[c].to_numpy() for c in ("group_row_index", "h", "n_records"))
        order = np.lexsort((ids, h, -size))
        ids, size = ids[order], size[order].tolist()
        room = self.room if self.room.sum() > 0 else np.array(self.shares)
        space, out = (room / room.sum() * sum(size)).tolist(), []
        for n in size:
            s = max(self.splits, key=space.__getitem__)
            space[s] -= n
            out.append(s)
        return self._table(ids, out)

    def _table(self, ids: np.ndarray, out: list[int]) -> pa.Table:
        return pa.table({"group_row_index": pa.array(ids, pa.int64()), "split_name": pa.array([self.names[s] for s in out], pa.string())})


def split_targets(targets: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names, shares, minima) of a table of configuration, shares adding up to 1; rows without a name or a share are left out, the largest row holds of repeated names."""
    rows = targets.where("split_name is not null and target_share > 0").groupBy("split_name").agg(F.max("target_share").alias("p"), F.coalesce(F.max("min_per_class"), F.lit(0)).alias("m")).orderBy("split_name").collect()
    if not rows:
        raise ValueError("no split has a target share")
    shares = np.array([float(r.p) for r in rows])
    return [r.split_name for r in rows], shares / shares.sum(), np.array([float(r.m) for r in rows])


def class_totals(per: DataFrame) -> DataFrame:
    """(class, total, largest, n): records, those of its largest group, groups, from (group_row_index, class, n)."""
    return per.groupBy("class").agg(F.sum("n").alias("total"), F.max("n").alias("largest"), F.count("*").alias("n"))


def assign_splits(records: DataFrame, proteins: DataFrame, targets: DataFrame, seed: int = 20260925) -> DataFrame:
    """(row_index, group_row_index, split_name) of every record. targets: split_name, target_share, min_per_class (a few rows).
    Null and unreadable cells are groups without a class; an empty table gives none."""
    return _assigned(records, proteins, targets, seed)[0]


def _assigned(records: DataFrame, proteins: DataFrame, targets: DataFrame, seed: int = 20260925) -> tuple[DataFrame, DataFrame]:
    """The assignment and (group_row_index, class, n)."""
    names, shares, least = split_targets(targets)
    spark = records.sparkSession
    groups = materialize(record_groups(records), "groups")
    held = held_values(records, proteins).select("row_index", F.col("value").alias("class"))
    per = materialize(groups.join(held, "row_index").groupBy("group_row_index", "class").agg(F.count("*").alias("n")), "held")
    sizes = materialize(groups.groupBy("group_row_index").agg(F.count("*").alias("n_records")), "sizes")
    n_all, n_groups = (int(x) for x in sizes.agg(F.coalesce(F.sum("n_records"), F.lit(0)), F.count("*")).first())
    room = n_all * shares  # records that each split still has room for
    giant = F.col("n_records") > max(1.0, GIANT_SHARE * shares.min() * n_all)
    rows = []
    for r in sorted(sizes.where(giant).collect(), key=lambda r: (-r.n_records, r.group_row_index)):
        s = int(np.argmax(room / shares))
        room[s] -= r.n_records
        rows.append((r.group_row_index, names[s]))
    placed = [spark.createDataFrame(rows, "group_row_index long, split_name string")] if rows else []
    big = [g for g, _ in rows]
    small = per.where(~F.col("group_row_index").isin(big)) if big else per
    totals = class_totals(per).withColumn("feasible", F.col("total") - F.col("largest") >= float(least.sum() - least.min()))
    totals = totals.withColumn("feasible", F.col("feasible") & (F.col("total") >= float(least.sum())))
    if big:  # what the large groups hold of each class
        brought = per.join(F.broadcast(placed[0]), "group_row_index").groupBy("class").agg(F.array(*[F.sum(F.when(F.col("split_name") == x, F.col("n")).otherwise(0)).cast("double") for x in names]).alias("got"))
        totals = totals.join(brought, "class", "left")
    else:
        totals = totals.withColumn("got", F.lit(None).cast("array<double>"))
    totals = materialize(totals, "totals")
    known = hot_join(small, totals.drop("n"), "class", hot_keys(totals, "class", n_all))
    vector = F.struct(F.col("class").alias("c"), "n", "total", F.col("feasible").alias("floor"), "got")
    # a group's classes are at most its values; large groups are gone
    vectors = known.groupBy("group_row_index").agg(F.min(F.struct("total", "class")).alias("m"), F.collect_list(vector).alias("classes"))
    h = F.xxhash64(F.lit(seed), "group_row_index")
    parts = max(1, -(-n_groups // BUCKET))
    home = F.pmod(F.xxhash64(F.lit(seed), "class"), F.lit(parts))
    bucket = F.when(F.col("m.total") <= HOME, F.pmod(F.xxhash64(F.lit(seed), "m.class"), F.lit(parts))).otherwise(F.pmod("h", F.lit(parts)))
    mine = F.transform("classes", lambda x: F.struct(x["c"].alias("c"), x["n"].alias("n"), (x["floor"] & (x["total"] <= HOME) & (F.pmod(F.xxhash64(F.lit(seed), x["c"]), F.lit(parts)) == F.col("bucket"))).alias("floor"), x["got"].alias("got")))
    ready = sizes.join(vectors, "group_row_index").withColumn("h", h).withColumn("bucket", bucket).select("group_row_index", "n_records", "h", "bucket", mine.alias("classes"))
    first_room, kind = Placer(names, shares, least, room.copy()), "group_row_index long, split_name string"
    first = materialize(ready.groupBy("bucket").applyInArrow(lambda t: first_room.labelled(t), kind), "placed")
    placed.append(first)
    for r in sizes.join(first, "group_row_index").groupBy("split_name").agg(F.sum("n_records").alias("n")).collect():
        room[names.index(r.split_name)] -= r.n
    last_room = Placer(names, shares, least, room.copy())
    bare = sizes.join(per.select("group_row_index").distinct(), "group_row_index", "left_anti").where(~giant).withColumn("h", h)
    placed.append(materialize(bare.groupBy(F.pmod("h", F.lit(parts)).alias("bucket")).applyInArrow(lambda t: last_room.rest(t), kind), "placed"))
    where = reduce(DataFrame.unionByName, placed)
    return hot_join(groups, where, "group_row_index", big).select("row_index", "group_row_index", "split_name"), per


def tied_groups(records: DataFrame, proteins: DataFrame, targets: DataFrame) -> DataFrame:
    """(row_index, group_row_index) of the records in a group of two or more, as the splits keep them together; group_row_index is
    the group's smallest row_index."""
    a = materialize(assign_splits(records, proteins, targets), "assigned")
    several = materialize(a.groupBy("group_row_index").agg(F.count("*").alias("n"), F.count_distinct("split_name").alias("k")).where("n > 1 and k = 1"), "several")
    hot = hot_keys(several, "group_row_index", a.count())
    return hot_join(a, several.select("group_row_index", "k"), "group_row_index", hot).select("row_index", "group_row_index")


def split_report(records: DataFrame, proteins: DataFrame, targets: DataFrame) -> DataFrame:
    """(split_name, label_value, n_records, n_class, share, target_share, minimum, feasible, met): each value of each split, share of its records.

    label_value null is the line of all records of the split. minimum is that of the split, feasible whether the class has enough
    records, outside its largest group too, for all minima; met: n_records reaches it.
    """
    names, shares, least = split_targets(targets)
    a, per = _assigned(records, proteins, targets)
    a = materialize(a, "assigned")
    where = a.groupBy("group_row_index", "split_name").agg(F.count("*").alias("n_group"))
    where = materialize(where, "where")
    cells = per.join(where, "group_row_index").groupBy("split_name", "class").agg(F.sum("n").alias("n_records"))
    spark = records.sparkSession
    t = spark.createDataFrame([(n, float(p), int(m)) for n, p, m in zip(names, shares, least)], "split_name string, target_share double, minimum int")
    totals = class_totals(per).select("class", F.col("total").alias("n_class"), ((F.col("total") >= float(least.sum())) & (F.col("total") - F.col("largest") >= float(least.sum() - least.min()))).alias("feasible"))
    grid = totals.crossJoin(F.broadcast(t))  # a row per class and split
    of = grid.join(cells, ["split_name", "class"], "left").select("split_name", F.col("class").alias("label_value"), F.coalesce("n_records", F.lit(0)).alias("n_records"), "n_class", "target_share", "minimum", "feasible")
    n_all = a.count()
    whole = where.groupBy("split_name").agg(F.sum("n_group").alias("n_records"))
    lines = F.broadcast(t).join(whole, "split_name", "left").select("split_name", F.lit(None).cast("int").alias("label_value"), F.coalesce("n_records", F.lit(0)).alias("n_records"), F.lit(n_all).cast("long").alias("n_class"), "target_share", F.lit(0).alias("minimum"), F.lit(True).alias("feasible"))
    rows = of.unionByName(lines)
    return rows.withColumn("share", F.when(F.col("n_class") > 0, F.col("n_records") / F.col("n_class"))).withColumn("met", F.col("n_records") >= F.col("minimum"))


def split_checks(records: DataFrame, proteins: DataFrame, targets: DataFrame) -> DataFrame:
    """(split_name, shares_ok, minima_ok, classes_ok) of every split: its share of all records within a point of the target, or within
    what the feasible minima ask for beyond the shares; every feasible minimum met; classes of LARGE_CLASS records or more within
    3 points of the target or at their minimum."""
    r = materialize(split_report(records, proteins, targets), "report")
    off = F.abs(F.col("share") - F.col("target_share"))
    label = F.col("label_value").isNotNull()
    asked = F.when(label & F.col("feasible"), F.greatest(F.lit(0.0), F.col("minimum") - F.col("n_class") * F.col("target_share"))).otherwise(0.0)
    per = r.groupBy("split_name").agg(
        F.max(F.when(~label, off)).alias("off"), F.max(F.when(~label, F.col("n_class"))).alias("n"), F.sum(asked).alias("asked"),
        F.min(F.when(label & F.col("feasible"), F.col("met")).otherwise(True)).alias("minima_ok"),
        F.min(F.when(label & (F.col("n_class") >= LARGE_CLASS), (off <= 0.03) | (F.col("n_records") == F.col("minimum"))).otherwise(True)).alias("classes_ok"),
    )
    more = per.agg(F.sum("asked").alias("all_asked"))  # one row
    ok = (F.col("n") == 0) | (F.col("off") <= 0.01 + F.greatest("asked", "all_asked") / F.col("n"))
    return per.join(F.broadcast(more)).select("split_name", F.coalesce(ok, F.lit(True)).alias("shares_ok"), "minima_ok", "classes_ok")
