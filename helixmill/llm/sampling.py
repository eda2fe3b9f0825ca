"""A sample whose classes follow target counts (problem 2): exponential tilting, Newton steps on its dual, the pivotal method.

A class is a signed value; a record holds it once however often its cell repeats it. From N records a sample is drawn in which
class j has t_j = n * c_j / T records in expectation, n = floor(N / 5), c_j its count in the newest audit and T the sum of all.

* Records of a class with no more records than its floor max(1, floor(t_j)) are taken for certain.
* All others get p = min(1, d * exp(sum of lambda of their classes)), d = n / N. The lambdas, within bounds, minimise the convex
  dual, by Newton steps. Gradient and Hessian are sums over records with equal class lists, made by all tasks; to the driver come
  a number a class and one a pair of classes that occur together.
* The pivotal method draws from these p in buckets of records with one rarest class, those of equal class lists side by side, so
  that each list comes out near its expectation; what a bucket leaves undecided goes to the next round.
* Then the counts are fixed: records of one class alone are added or dropped, as they change no other class, until the class has
  round(t_j) records, at least its floor; classes still below their floor get more of their other records. What can't be
  reached stands in the report.

Records without a class of the audit are never drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.labels import first_delivery
from helixmill.llm.records import held_values, newest_audit
from helixmill.session import materialize

ONE_IN = 5
SEED = 20260925
BUCKET = 4096
#: Up to so many classes the driver solves a dense system; beyond, it iterates on the pairs of classes that occur together.
DENSE = 2000
#: No lambda leaves these bounds: a class that others bring anyway, or that all its records can't fill, ends there.
BOUND = 12.0
#: Parts of the hash order in which records of a class are counted, so that no task orders all of them.
PARTS = 1024
_RIDGE = 1e-6


def class_plan(records: DataFrame, proteins: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(classes, lists, n_records). classes (label_value, target_count, target, need, available); lists (row_index, classes):
    each record's distinct classes of the audit, sorted."""
    n_records = first_delivery(records, "row_index", [], None).count()
    n = n_records // ONE_IN
    a = newest_audit(audit)
    both = a.select(F.col("protein_id").alias("label_value"), F.coalesce("positive_count", F.lit(0)).alias("c")).unionByName(a.select((-F.col("protein_id")).alias("label_value"), F.coalesce("negative_count", F.lit(0)).alias("c")))
    held = materialize(held_values(records, proteins), "values")
    both = both.withColumn("total", F.sum("c").over(Window.partitionBy()))  # two rows a protein
    total = F.col("total")
    t = F.when(total > 0, F.lit(float(n)) * F.col("c") / total).otherwise(0.0)
    avail = held.groupBy("value").agg(F.count("*").alias("available"))
    plan = both.withColumn("target", t).withColumn("need", F.greatest(F.lit(1), F.when(total > 0, F.expr(f"({n}L * c) div total")).otherwise(0)).cast("long"))
    classes = materialize(plan.join(avail, plan.label_value == avail.value, "left").select(F.col("label_value").cast("int").alias("label_value"), F.col("c").alias("target_count"), "target", "need", F.coalesce("available", F.lit(0)).alias("available")), "classes")
    known = F.broadcast(classes.select("label_value"))  # two rows a protein of a dictionary table
    lists = held.join(known, held.value == classes.label_value, "left_semi").groupBy("row_index").agg(F.array_sort(F.collect_list("value")).alias("classes"))
    return classes, lists, n_records


def _flat(column: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of each class, its row, first place of each row) of class lists; no list is empty. labels is sorted."""
    sizes = np.diff(column.offsets.to_numpy())
    x = np.searchsorted(labels, column.flatten().to_numpy())
    return x, np.repeat(np.arange(len(column)), sizes), np.cumsum(sizes) - sizes


def _newton_step(free: np.ndarray, grad: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray, damp: float = 1e-3) -> np.ndarray:
    """The solution of (H + damp) x = -grad over the free classes; H symmetric, given by its upper part."""
    k = len(free)
    at = np.full(k, -1)
    at[free] = np.arange(int(free.sum()))
    own = free[i] & free[j]
    a, b, w = at[i[own]], at[j[own]], v[own]
    m, g = int(free.sum()), grad[free]
    step = np.zeros(k)
    if m <= DENSE:
        h = np.zeros((m, m))
        h[a, b] = w
        h[b, a] = w
        step[free] = np.linalg.solve(h + damp * np.eye(m), -g)
        return step
    off = a != b
    diag = np.bincount(a[~off], weights=w[~off], minlength=m) + damp

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(a, weights=w * x[b], minlength=m) + np.bincount(b[off], weights=w[off] * x[a[off]], minlength=m) + damp * x

    x, r = np.zeros(m), -g  # conjugate gradients
    z = r / diag
    p, rz = z.copy(), r @ z
    for _ in range(500):
        if np.abs(r).max(initial=0.0) <= 1e-6 * max(1.0, np.abs(g).max(initial=0.0)):
            break
        q = times(p)
        alpha = rz / (p @ q)
        x += alpha * p
        r -= alpha * q
        z = r / diag
        new = r @ z
        p, rz = z + new / rz * p, new
    step[free] = x
    return step


def tilt(lists: DataFrame, labels: np.ndarray, targets: np.ndarray, d: float, certain: np.ndarray, steps: int = 60, tolerance: float = 0.005) -> tuple[np.ndarray, bool]:
    """(lambda by class, converged), from (row_index, classes). certain: classes whose records are taken for certain. converged:
    every class has its target within the tolerance (a share of it, or of one record), or its lambda is at a bound."""
    patterns = materialize(lists.groupBy("classes").agg(F.count("*").alias("n")), "patterns")
    k = len(labels)

    def sums(lam: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, f, keys, values = np.zeros(k), 0.0, np.zeros(0, np.int64), np.zeros(0)
            for b in batches:
                if not b.num_rows:
                    continue
                x, row, first = _flat(b.column("classes"), labels)
                n = b.column("n").to_numpy().astype(float)
                u = np.add.reduceat(lam[x], first)
                sure = np.logical_or.reduceat(certain[x], first)
                inside = ~sure & (u < -np.log(d))
                p = np.where(inside, d * np.exp(np.minimum(u, 50.0)), 1.0)
                g += np.bincount(x, weights=(n * p)[row], minlength=k)
                f += float((n * np.where(sure, u, np.where(inside, p, 1 + u + np.log(d)))).sum())
                w = np.where(inside, n * p, 0.0)
                kk, ww = [keys], [values]
                for shift in range(int(np.bincount(row).max())):
                    lo, hi = x[: len(x) - shift], x[shift:]
                    same = row[: len(row) - shift] == row[shift:]
                    kk.append(lo[same] * np.int64(k) + hi[same])
                    ww.append(w[row[shift:][same]])
                keys, back = np.unique(np.concatenate(kk), return_inverse=True)
                values = np.bincount(back, weights=np.concatenate(ww), minlength=len(keys))
            i, j = keys // k, keys % k
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.full(k, -2), i]), pa.array(np.r_[-1, np.arange(k), j]), pa.array(np.r_[f, g, values])], names=["i", "j", "v"])

        rows = patterns.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
        i, j, v = (rows[c].to_numpy() for c in ("i", "j", "v"))
        g = np.zeros(k)
        g[j[i == -2]] = v[i == -2]
        up = i >= 0
        return g, (i[up], j[up], v[up]), float(v[i == -1].sum())

    def value(f: float, lam: np.ndarray) -> float:
        return f - lam[~certain] @ targets[~certain] + _RIDGE / 2 * lam @ lam

    lam, close = np.zeros(k), tolerance * np.maximum(1.0, targets)
    g, h, f = sums(lam)
    for _ in range(steps):
        grad = g - targets + _RIDGE * lam
        free = ~certain & ~((lam >= BOUND) & (grad < 0)) & ~((lam <= -BOUND) & (grad > 0))
        if not free.any() or (np.abs(grad) <= close)[free].all():
            return lam, True
        while True:  # a lambda at a bound that the others would push out stays there
            step = _newton_step(free, grad, *h)
            out = free & (((lam >= BOUND) & (step > 0)) | ((lam <= -BOUND) & (step < 0)))
            if not out.any():
                break
            free &= ~out
        step *= min(1.0, 4 / max(1e-12, np.abs(step).max()))
        size = 1.0
        for _ in range(12):  # halve until the objective falls
            trial = np.clip(lam + size * step, -BOUND, BOUND)
            got = sums(trial)
            if value(got[2], trial) <= value(f, lam) + 1e-10 * abs(f):
                break
            size /= 2
        else:
            return lam, False
        lam, (g, h, f) = trial, got
    return lam, False


def pivotal(p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int | None]:
    """The pivotal method as a tournament of neighbours: (decided 0 or 1, the place of the one left undecided or None). p changes in place.

    Of two neighbours one is decided and the other goes on with what is left of both probabilities; each keeps its own in expectation.
    """
    idx = np.flatnonzero((p > 1e-12) & (p < 1 - 1e-12))
    while len(idx) > 1:
        a, b = idx[: len(idx) // 2 * 2 : 2], idx[1 :: 2]
        pa_, pb, u = p[a], p[b], rng.random(len(a))
        s = pa_ + pb
        low = s < 1
        first = np.where(low, u * s < pa_, u * (2 - s) < 1 - pb)  # a wins
        p[a] = np.where(low, np.where(first, s, 0.0), np.where(first, 1.0, s - 1))
        p[b] = np.where(low, np.where(first, 0.0, s), np.where(first, s - 1, 1.0))
        idx = idx[(p[idx] > 1e-12) & (p[idx] < 1 - 1e-12)]
    out = (p >= 1 - 1e-12).astype(np.int8)
    return out, int(idx[0]) if len(idx) else None


def _round(undecided: DataFrame, seed: int) -> DataFrame:
    """(row_index, p, state) of one pivotal round in buckets of about BUCKET records of like label; state 1, 0, or 2: undecided."""
    size = undecided.groupBy("label").agg(F.ceil(F.count("*") / BUCKET).alias("parts"))
    placed = undecided.join(F.broadcast(size), "label").withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "row_index"), F.col("parts")))  # a row a class

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("row_index", "ascending")])
        ids = t["row_index"].to_numpy()
        rng = np.random.default_rng([seed, abs(int(t["label"][0].as_py())), int(t["part"][0].as_py())])
        order = np.lexsort((rng.random(len(ids)), t["tie"].to_numpy()))
        p = t["p"].to_numpy().copy()[order]
        state, left = pivotal(p, rng)
        if left is not None:
            state[left] = 2
        back = np.argsort(order)
        return pa.table({"row_index": ids, "p": p[back], "state": state[back].astype(np.int32)})

    return placed.select("row_index", "label", "part", "tie", "p").groupBy("label", "part").applyInArrow(run, "row_index long, p double, state int")


def _first(candidates: DataFrame, seed: int) -> DataFrame:
    """(row_index, label_value, kind) of the first `quota` candidates (row_index, label_value, kind, quota) of each class and kind in
    the order of a hash, counted in PARTS parts of it."""
    keys = ["label_value", "kind"]
    c = candidates.withColumn("h", F.xxhash64(F.lit(seed), "row_index")).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "row_index"), F.lit(PARTS)))
    before = c.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("part")) - F.col("n")).select(*keys, "part", "before")
    at = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("h", "row_index")) + F.col("before")
    return c.join(before, [*keys, "part"]).where("before < quota").withColumn("at", at).where("at <= quota").select("row_index", *keys)


def draw(records: DataFrame, proteins: DataFrame, audit: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample (row_index, p): the drawn records, p their probability before the counts were fixed.
    report (label_value, target, need, goal, available, forced, drawn, target_share, drawn_share, reached, converged) of every class
    of the audit. goal: the records it is to have, at most all; forced: those that come for certain with small classes; reached:
    drawn >= need; converged: of the Newton steps."""
    spark = records.sparkSession
    classes, lists, n_records = class_plan(records, proteins, audit)
    lists = materialize(lists, "lists")
    rows = sorted(classes.collect())
    labels = np.array([r.label_value for r in rows], np.int64)
    target = np.array([float(r.target) for r in rows])
    need, available = (np.array([int(r[c]) for r in rows], np.int64) for c in ("need", "available"))
    certain = available <= need
    goal = np.minimum(np.maximum(np.floor(target + 0.5).astype(np.int64), need), available)
    wanted = np.minimum(np.maximum(target, need), available)  # the floor of a small class is its target
    d = 1 / ONE_IN
    lam, converged = tilt(lists, labels, wanted, d, certain) if rows else (np.zeros(0), True)
    rank = np.argsort(np.lexsort((labels, available)))
    by_rank = labels[np.argsort(rank)] if rows else labels

    def probability(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, _, first = _flat(b.column("classes"), labels)
            sure = np.logical_or.reduceat(certain[x], first)
            p = np.where(sure, 1.0, np.minimum(1.0, d * np.exp(np.minimum(50.0, np.add.reduceat(lam[x], first)))))
            label = by_rank[np.minimum.reduceat(rank[x], first)]
            yield pa.RecordBatch.from_arrays([b.column("row_index"), b.column("classes"), b.column("tie"), pa.array(label.astype(np.int32)), pa.array(p), pa.array(sure)], names=["row_index", "classes", "tie", "label", "p", "sure"])

    with_p = materialize(lists.withColumn("tie", F.xxhash64("classes")).mapInArrow(probability, "row_index long, classes array<int>, tie long, label int, p double, sure boolean"), "probabilities")
    open_, taken, turn = with_p, None, 0
    while True:
        done = materialize(_round(open_, seed + turn), "round")
        now = done.where("state = 1").select("row_index")
        taken = now if taken is None else taken.unionByName(now)
        left = done.where("state = 2").select("row_index", F.lit(0).cast("long").alias("tie"), F.lit(0).alias("label"), "p")
        turn += 1
        if turn > 1 and left.count() <= 1:
            break
        open_ = left
    coin = F.pmod(F.xxhash64(F.lit(seed), "row_index"), F.lit(1 << 30)) / float(1 << 30)  # the very last one
    taken = taken.unionByName(left.where(coin < F.col("p")).select("row_index")).withColumn("drawn", F.lit(True))
    state = with_p.join(taken, "row_index", "left").select("row_index", "classes", "p", "sure", F.coalesce("drawn", F.lit(False)).alias("drawn"))
    state = materialize(state, "state")

    # what is to be added or dropped, by class; a row a class comes to the driver
    alone = (F.size("classes") == 1) & ~F.col("sure")
    each = state.select("drawn", "sure", alone.alias("alone"), F.explode("classes").alias("label_value"))
    n = lambda c: F.count(F.when(c, 1))
    is_drawn = F.col("drawn")
    counts = each.groupBy("label_value").agg(n(is_drawn).alias("drawn"), n(F.col("sure")).alias("forced"), n(is_drawn & F.col("alone")).alias("can_drop"), n(~is_drawn & F.col("alone")).alias("can_add"))
    quotas, forced = [], {}
    at = {int(c): i for i, c in enumerate(labels)}
    for r in counts.collect():
        i = at[r.label_value]
        forced[r.label_value] = r.forced
        gap = int(goal[i]) - r.drawn
        if gap < 0 and r.can_drop:
            quotas.append((r.label_value, "drop", min(-gap, r.can_drop)))
        if gap > 0 and r.can_add:
            quotas.append((r.label_value, "add", min(gap, r.can_add)))
        if (short := min(int(need[i]), int(available[i])) - r.drawn - min(max(gap, 0), r.can_add)) > 0:
            quotas.append((r.label_value, "fill", short))
    wanted_rows = F.broadcast(spark.createDataFrame(quotas, "label_value int, kind string, quota long"))
    kind = F.when(alone, F.when(F.col("drawn"), "drop").otherwise("add")).when(~F.col("drawn"), "fill")
    picks = _first(state.select("row_index", kind.alias("kind"), F.explode("classes").alias("label_value")).join(wanted_rows, ["label_value", "kind"]), seed)
    picks = picks.groupBy("row_index").agg(F.min("kind").alias("kind"))
    sample = state.join(picks, "row_index", "left").where((F.col("drawn") & F.col("kind").isNull()) | F.col("kind").isin("add", "fill"))
    sample = materialize(sample.select("row_index", "classes", "p"), "sample")
    got = sample.select(F.explode("classes").alias("label_value")).groupBy("label_value").agg(F.count("*").alias("drawn"))
    one = Window.partitionBy()
    fixed = spark.createDataFrame([(int(c), int(g), int(forced.get(int(c), 0))) for c, g in zip(labels, goal)], "label_value int, goal long, forced long")
    rep = classes.join(F.broadcast(fixed), "label_value").join(got, "label_value", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    all_target, all_drawn = F.sum("target_count").over(one), F.sum("drawn").over(one)
    report = rep.select("label_value", "target", "need", "goal", "available", "forced", "drawn", F.when(all_target > 0, F.col("target_count") / all_target).alias("target_share"), F.when(all_drawn > 0, F.col("drawn") / all_drawn).alias("drawn_share"), (F.col("drawn") >= F.col("need")).alias("reached"), F.lit(bool(converged)).alias("converged"))
    return sample.select("row_index", "p"), report


def short_classes(records: DataFrame, proteins: DataFrame, audit: DataFrame) -> DataFrame:
    """(label_value): the classes of which the sample, with all floors filled as far as records reach, holds fewer than they need."""
    return draw(records, proteins, audit)[1].where(~F.col("reached")).select("label_value")


def sample_checks(records: DataFrame, proteins: DataFrame, audit: DataFrame) -> DataFrame:
    """(converged, floors_ok, targets_ok), one row: the Newton steps converged; every class has its floor or all its records; of the
    classes that may have their goal (not forced beyond it) 95 percent or more are within 5 percent or one record of it."""
    r = draw(records, proteins, audit)[1]
    near = F.abs(F.col("drawn") - F.col("goal")) <= F.greatest(F.lit(1.0), 0.05 * F.col("goal"))
    fair = F.col("forced") <= F.col("goal")
    share = F.sum(F.when(fair & near, 1).otherwise(0)) >= 0.95 * F.sum(F.when(fair, 1).otherwise(0))
    return r.agg(F.min("converged").alias("converged"), F.min(F.col("drawn") >= F.least("need", "available")).alias("floors_ok"), share.alias("targets_ok"))
