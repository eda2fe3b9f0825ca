"""Areas, thresholds, intervals, controls and the deterministic sample against plain Python."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from helixmill.functions.sequence import decode_bits, encode_bases, one_hot_problem
from helixmill.functions.stats import wilson
from helixmill.operators import codependence as D
from helixmill.operators import evaluation as E
from helixmill.operators.audit import rank_auc
from helixmill.operators.components import components
from helixmill.operators.sampling import QuotaError, build_sample


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a, b in product(pos, neg)) / (len(pos) * len(neg)) if pos and neg else None


@pytest.mark.parametrize("rows", [[(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], [(1.0, 1), (1.0, 0), (1.0, 0)], [(0.5, 1)], [(i % 3, i % 2) for i in range(20)]])
def test_auc(spark, rows):
    df = spark.createDataFrame([(1, float(s), y) for s, y in rows], "k int, score double, y int")
    assert rank_auc(df, ["k"]).collect()[0].auc == (None if brute_auc(rows) is None else pytest.approx(brute_auc(rows)))


def test_thresholds_and_ap(spark):
    rows = [(1, 0.9, 1), (1, 0.8, 0), (1, 0.8, 1), (1, 0.2, 0), (2, 0.5, 0)]
    df = spark.createDataFrame(rows, "k int, score double, y int")
    ap = {r.k: r.ap for r in E.average_precision(df, ["k"]).collect()}
    assert ap[1] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3) and ap[2] is None
    assert {r.k: r.threshold for r in E.best_f1_thresholds(df, ["k"]).collect()} == {1: 0.8, 2: 0.5}
    assert {r.k: r.threshold for r in E.grid_thresholds(df, ["k"]).collect()} == {1: 0.3, 2: 0.5}


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "k long, n long")
    p, lo, hi = wilson(F.col("k"), F.col("n"))
    rows = [tuple(r) for r in df.select(p, lo, hi).collect()]
    assert rows[0] == (0, 0, 0) and rows[1] == (0.5, pytest.approx(0.23659, abs=1e-4), pytest.approx(0.76341, abs=1e-4)) and rows[2][2] == 1.0


def test_bits(spark):
    df = spark.createDataFrame([("10000100",), ("11000100",), ("",), (None,), ("1000" * 20_000,)], "b string")
    out = [tuple(r) for r in df.select(decode_bits("b"), one_hot_problem("b", 2)).collect()]
    assert out[0] == ("AC", None) and out[1] == (None, "counts") and out[2] == ("", "length") and out[3][1] == "length" and out[4][0] == "A" * 20_000
    assert df.sparkSession.createDataFrame([("ACN",), ("AC",)], "s string").select(encode_bases("s")).collect()[1][0] == "10000100"


def test_sample(spark):
    ids = spark.createDataFrame([(i, f"row_{i}") for i in range(60)], "row_index long, sample_id string")
    obs = spark.createDataFrame([(i, i % 3 + 1, i % 2) for i in range(60)], "row_index long, protein_id int, y int")
    a = build_sample(ids, obs, 40, 10, 5, 5, 7, proteins=3)
    b = build_sample(ids.orderBy(F.desc("row_index")).repartition(5), obs.repartition(3), 40, 10, 5, 5, 7, proteins=3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 40
    got = a.join(obs, "row_index").groupBy("protein_id", "y").count().collect()
    assert all(r["count"] >= 5 for r in got) and len(got) == 6
    with pytest.raises(QuotaError):
        build_sample(ids, obs, 40, 10, 50, 5, 7, proteins=3)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == {n: find(n) for n in list(parent)}
    assert components(df.limit(0)).count() == 0


def test_clusters(spark):
    m = [(i, j, 0.9 if (i <= 3) == (j <= 3) else 0.01) for i in range(1, 7) for j in range(1, 7)]
    c = D.clusters(spark.createDataFrame(m, "i int, j int, p double")).collect()
    assert {frozenset(r.protein_id for r in c if r.cluster == k) for k in {r.cluster for r in c}} == {frozenset({1, 2, 3}), frozenset({4, 5, 6})}
    assert D.clusters(spark.createDataFrame([], "i int, j int, p double")).count() == 0


def test_component_of_a_hub(spark):
    """A third of all nodes hang on one node, the rest in chains."""
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(10_000, 10_050)] + [(2999, 10_050)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 3051 and set(got.values()) == {0}


def test_baselines(spark):
    from helixmill.operators import partitions as P

    w = spark.createDataFrame([(i, ("ACGTT" * 20 if i % 2 else "GGCCA" * 20) + "N" * (i % 3)) for i in range(60)] + [(60, ""), (61, None)], "row_index long, seq string")
    f = {r.row_index: r.features for r in P.baseline_features(w, "3-mer").collect()}
    assert abs(sum(f[1]) - 1) < 1e-9 and len(f[1]) == 64 and sum(f[60]) == sum(f[61]) == 0 and abs(f[1][0b000110] - 20 / 98) < 1e-9  # ACG
    assert len(P.baseline_features(w.limit(1), "6-mer").first().features) == 4096
    o = spark.createDataFrame([(i, 7, i % 2) for i in range(60)], "row_index long, protein_id int, y int")
    a = spark.createDataFrame([(i, "train" if i < 40 else "test") for i in range(60)], "row_index long, split_name string")
    for kind in ("gc", "3-mer"):
        s = P.baseline(w, o, a, 7, kind).where("split_name = 'test'").collect()
        assert min(r.score for r in s if r.y) > max(r.score for r in s if not r.y)
    assert P.baseline(w, o, a, 7, "random").count() == 60
