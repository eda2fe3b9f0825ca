"""Frequencies, splits and samples: exact counts, whole groups, shares, floors."""

import datetime as dt
import random

import numpy as np
import pytest

from helixmill import session
from helixmill.llm import frequency, sampling, splits
from helixmill.llm.records import newest_audit, record_values, transcript_key

T = dt.datetime(2025, 1, 1)
TURN = str.maketrans("ACGTN", "TGCAN")


def test_counts(spark, monkeypatch):
    monkeypatch.setattr(frequency, "HEAVY_SHARE", 0.05)
    rng = random.Random(1)
    rows = [(i, int(rng.paretovariate(0.7)) if rng.random() < 0.6 else 7) for i in range(3000) for _ in range(rng.randint(0, 4))]  # one value holds a third and more
    df = spark.createDataFrame(rows, "row_index long, value int").repartitionByRange(5, "row_index").sortWithinPartitions("row_index").selectExpr("*", "1 as n_records")
    occ, rec = {}, {}
    for r, v in rows:
        occ[v] = occ.get(v, 0) + 1
        rec.setdefault(v, set()).add(r)
    for batch in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r.value: (r.n_occurrences, r.n_records) for r in frequency.value_counts(df).collect()}
        assert got == {v: (occ[v], len(rec[v])) for v in occ}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    marks = {r.value: r.mark for r in frequency.marked_counts(df, 3000).collect()}
    assert marks == {v: "rare" if len(s) <= 2 else "common" if len(s) > 150 else None for v, s in rec.items()}
    assert frequency.value_counts(df.limit(0)).count() == 0
    assert 7 in frequency.heavy_values(df)


def test_counts_over_straddling_splits(spark, tmp_path):
    """A record whose values lie in several row groups, read in several splits, counts once; so do strings."""
    df = spark.createDataFrame([(1, ";".join(["5"] * 3 + [str(i) for i in range(6, 400)] + ["5"] * 2)), (2, "5")], "row_index long, labels string")
    v = record_values(df, spark.createDataFrame([(1, "AAA1")], "protein_id int, protein_name string"))
    v.coalesce(1).write.option("parquet.block.size", 1024).option("parquet.page.size", 256).parquet(str(tmp_path / "v"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        back = spark.read.parquet(str(tmp_path / "v"))
        assert {r.value: (r.n_occurrences, r.n_records) for r in frequency.value_counts(back).where("value < 8").collect()} == {5: (6, 2), 6: (1, 1), 7: (1, 1)}
        bare = back.selectExpr("row_index", "concat('t', value) as value").repartition(5)
        assert {r.value: (r.n_occurrences, r.n_records) for r in frequency.value_counts(bare).where("value < 't51'").collect()}["t5"] == (6, 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def records(spark, n=900, seed=3):
    rng = random.Random(seed)
    rows, seqs = [], []
    for i in range(n):
        s = rng.choice(seqs) if seqs and rng.random() < 0.1 else "".join(rng.choice("ACGTN") for _ in range(40))
        if rng.random() < 0.3:
            s = s.translate(TURN)[::-1]
        seqs.append(s)
        t = "TX9" if i % 3 == 0 and seed == 4 else rng.choice([f"TX{rng.randrange(n)}", f" tx{rng.randrange(n)}.2", None, "", "n/a", "-"])
        labels = ";".join(str(rng.choice([-1, 1]) * min(122, int(rng.paretovariate(1)))) for _ in range(rng.randint(0, 3)))
        rows.append((i, s if i % 50 else None, t, labels or None, T, "x"))
    rows += [(r[0], *r[1:4], T + dt.timedelta(9), "x") for r in rows[::20]] + [(None, "ACGT", "TX1", "5", T, "x")]
    return rows, spark.createDataFrame(rows, "row_index long, sequence string, transcript_id string, labels string, loaded_at timestamp, group_row_index string")


def brute_groups(rows):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s, t, *_ in rows:
        if i is None or i in parent:
            continue
        parent[i] = i
        t = (t or "").strip().lower().split(".")[0]
        for k in ([("t", t)] if t not in ("", "n/a", "-") else []) + ([("s", min(s, s.translate(TURN)[::-1]))] if s else []):
            if k in by:
                a, b = find(i), find(by[k])
                parent[max(a, b)] = min(a, b)
            by.setdefault(k, i)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("seed", [3, 4])
def test_groups_and_splits(spark, seed, monkeypatch):
    monkeypatch.setattr(session, "HOT_ROWS", 100)  # seed 4: one transcript of a third of all rows
    monkeypatch.setattr(session, "HOT_KEYS", 20)
    monkeypatch.setattr(splits, "BUCKET", 200)  # several buckets
    rows, df = records(spark, seed=seed)
    truth = brute_groups(rows)
    assert {r.row_index: r.group_row_index for r in splits.record_groups(df).collect()} == truth
    sizes = {}
    for g in truth.values():
        sizes[g] = sizes.get(g, 0) + 1
    proteins = spark.createDataFrame([(1, "AAA1")], "protein_id int, protein_name string")
    targets = spark.createDataFrame([("train", 0.7, 0), ("validation", 0.15, 3), ("test", 0.15, 3)], "split_name string, target_share double, min_per_class int")
    assert {r.row_index: r.group_row_index for r in splits.tied_groups(df, proteins, targets).collect()} == {i: g for i, g in truth.items() if sizes[g] > 1}
    a = {r.row_index: r.split_name for r in splits.assign_splits(df, proteins, targets).collect()}
    assert set(a) == set(truth) and len({(truth[i], s) for i, s in a.items()}) == len(set(truth.values()))
    share = {s: sum(x == s for x in a.values()) / len(a) for s in ("train", "validation", "test")}
    assert abs(share["validation"] - 0.15) < 0.08 and abs(share["test"] - 0.15) < 0.08
    r = splits.split_report(df, proteins, targets).where("label_value is not null").collect()
    frequent = [x for x in r if x.n_class >= 40]
    assert frequent and all(abs(x.share - x.target_share) < 0.12 for x in frequent)
    assert splits.assign_splits(df.limit(0), proteins, targets).count() == 0 and splits.tied_groups(df.limit(0), proteins, targets).count() == 0


def audit(spark, counts):
    rows = [("old", T - dt.timedelta(9), 1, 999, None, 1)] + [("new", T, p, a, b, None) for p, (a, b) in counts.items()] + [("new", T, 1, *counts[1], None), ("old", T + dt.timedelta(9), 1, 5, 5, 5), (None, None, 2, 1, 1, 1)]
    return spark.createDataFrame(rows, "audit_id string, audited_at timestamp, protein_id int, positive_count long, negative_count long, known_count long")


def test_newest_audit(spark):
    got = {r.protein_id: (r.positive_count, r.negative_count) for r in newest_audit(audit(spark, {1: (10, 20), 2: (0, None)})).collect()}
    assert got == {1: (10, 20), 2: (0, None)}


def test_sample(spark):
    rng = random.Random(5)
    # class 1 is a third of all rows, class 5 has two records only
    rows = [(i, ";".join({str(rng.choice([1, 1, -1, 2, -2, 3, 300])), str(rng.choice([1, 3, -3]))}) if i % 10 else None) for i in range(4000)] + [(5000, "5"), (5001, "5;1"), (5001, "5;1"), (None, "1")]
    df = spark.createDataFrame(rows, "row_index long, labels string").selectExpr("*", "0.5D as p", "1 as classes")
    proteins = spark.createDataFrame([(1, "AAA1")], "protein_id int, protein_name string")
    a = audit(spark, {1: (100, 50), 2: (40, 40), 3: (60, 10), 5: (40, 0)})
    n, total = 4002 // 5, 340
    held = {}
    for r, cell in {r: c for r, c in rows if r is not None}.items():
        for v in {int(x) for x in (cell or "").split(";") if x}:
            held.setdefault(v, set()).add(r)
    need = {v: max(1, n * c // total) for v, c in {1: 100, -1: 50, 2: 40, -2: 40, 3: 60, -3: 10, 5: 40, -5: 0}.items()}
    assert {r.label_value for r in sampling.short_classes(df, proteins, a).collect()} == {v for v, k in need.items() if len(held.get(v, ())) < k}
    sample, report = sampling.draw(df, proteins, a)
    ids = [r.row_index for r in sample.collect()]
    assert len(ids) == len(set(ids)) and {5000, 5001} <= set(ids)
    for r in report.collect():
        assert r.need == need[r.label_value] and r.drawn == len(held.get(r.label_value, set()) & set(ids)) and r.reached == (r.drawn >= r.need)
        if r.available > 3 * r.need > 30:
            assert r.drawn == pytest.approx(r.target, rel=0.05, abs=1)
    assert sampling.short_classes(df.limit(0), proteins, a).count() == 8
    assert all(r.converged for r in report.collect())
    s, r = sampling.draw(df.limit(0), proteins, a)
    assert s.count() == 0 and r.count() == 8


def test_pivotal_keeps_probabilities():
    rng, p = np.random.default_rng(1), np.array([0.2, 0.5, 0.9, 0.4, 1.0, 0.0, 0.7, 0.3])
    hits = np.zeros(8)
    for _ in range(6000):
        q = p.copy()
        state, left = sampling.pivotal(q, rng)
        if left is not None:
            state[left] = rng.random() < q[left]
        hits += state
        assert abs(state.sum() - p.sum()) <= 1
    assert np.allclose(hits / 6000, p, atol=0.03)


def test_transcripts(spark):
    df = spark.createDataFrame([("TX1.4 ",), (" tx1",), ("\tTX1.2\n",), ("N/A",), ("",), (None,), ("unknown",)], "t string")
    assert [r[0] for r in df.select(transcript_key("t")).collect()] == ["tx1", "tx1", "tx1", None, None, None, None]


def test_values_outside_the_proteins_are_classes(spark):
    """Zero and ids beyond the proteins get shares and minima of their own and lines in the report; values of one record each don't move the shares."""
    odd = [0, 125, 130, -125]
    rows = [(i, f"TX{i}", str(odd[i % 4] if i < 400 else 5) if i < 2000 else str(10_000 + i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_index long, transcript_id string, labels string").selectExpr("*", "cast(null as string) as sequence", "cast(null as timestamp) as loaded_at")
    proteins = spark.createDataFrame([(1, "AAA1")], "protein_id int, protein_name string")
    targets = spark.createDataFrame([("train", 0.7, 0), ("validation", 0.15, 12), ("test", 0.15, 12)], "split_name string, target_share double, min_per_class int")
    r = splits.split_report(df, proteins, targets).collect()
    lines = {(x.label_value, x.split_name): x for x in r}
    assert len(lines) == len(r) == 3 * (1 + 5 + 1000)
    assert all(lines[v, s].n_class == 100 and lines[v, s].met and abs(lines[v, s].share - lines[v, s].target_share) < 0.03 for v in odd for s in ("train", "validation", "test"))
    assert all(abs(lines[None, s].share - lines[None, s].target_share) < 0.03 for s in ("train", "validation", "test"))


def test_minima_and_shares(spark):
    """Feasible minima are all met, infeasible ones leave the shares, large classes keep theirs; in one bucket and in many."""
    rng = random.Random(8)
    rows = [(i, f"TX{rng.randrange(4000) if i % 2 else 10**6 + i}", ";".join(str(rng.choice([rng.randint(1, 20), 200 + int(rng.paretovariate(0.3)) % 60])) for _ in range(rng.choice([0, 1, 1, 1, 2])))) for i in range(6000)]
    df = spark.createDataFrame(rows, "row_index long, transcript_id string, labels string").selectExpr("*", "cast(null as string) as sequence", "cast(null as timestamp) as loaded_at")
    proteins = spark.createDataFrame([(1, "AAA1")], "protein_id int, protein_name string")
    targets = spark.createDataFrame([("train", 0.7, 0), ("validation", 0.15, 20), ("test", 0.15, 20)], "split_name string, target_share double, min_per_class int")
    for size in (40_000, 1000):
        splits.BUCKET, kept = size, splits.BUCKET
        try:
            assert all(x.shares_ok and x.minima_ok and x.classes_ok for x in splits.split_checks(df, proteins, targets).collect())
            r = splits.split_report(df, proteins, targets).collect()
        finally:
            splits.BUCKET = kept
        assert all(abs(x.share - x.target_share) < 0.01 for x in r if x.label_value is None)
        assert all(x.met for x in r if x.feasible) and any(not x.feasible for x in r)


def test_iterative_solution_equals_the_dense_one(monkeypatch):
    rng = np.random.default_rng(2)
    a = rng.random((30, 12))
    h = a.T @ a
    i, j = np.triu_indices(12)
    grad, free = rng.random(12), np.arange(12) != 4
    dense = sampling._newton_step(free, grad, i, j, h[i, j])
    monkeypatch.setattr(sampling, "DENSE", 2)
    assert np.allclose(sampling._newton_step(free, grad, i, j, h[i, j]), dense, atol=1e-4) and dense[4] == 0
