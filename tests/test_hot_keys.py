"""Joins and components whose one key holds a third of the rows: the same results, and no task that reads them all."""

import pytest
from pyspark.sql import functions as F

from helixmill import session
from helixmill.operators.components import components


@pytest.fixture
def low_limits(monkeypatch):
    monkeypatch.setattr(session, "HOT_ROWS", 500)
    monkeypatch.setattr(session, "HOT_KEYS", 20)


def task_rows(spark, run):
    """Rows that each task of the slowest-looking shuffle stage read, by stage, for the stages that run() makes."""
    store = spark.sparkContext._jsc.sc().statusStore()
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    run()
    out = []
    for j in set(tracker.getJobIdsForGroup(None)) - before:
        for s in tracker.getJobInfo(j).stageIds:
            try:
                tasks = store.taskList(s, 0, 10_000)
            except Exception:  # noqa: BLE001 - a skipped stage has none
                continue
            rows = [tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size()) if tasks.apply(i).taskMetrics().isDefined()]
            if sum(rows) > 0:
                out.append(sorted(rows))
    return out


def test_hot_join(spark, low_limits):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = session.materialize(spark.range(30_000).select(F.when(F.col("id") % 10 < 3, F.lit(-1)).when(F.col("id") % 10 == 4, F.lit(None)).otherwise(F.col("id") % 3000).cast("long").alias("k"), "id"))
        right = left.where("k is not null and k <> 5").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
        hot = session.hot_keys(right, "k", 30_000)
        assert hot == [-1] and session.hot_keys(right, "k", 400) == []
        for how in ("inner", "left"):
            got = session.hot_join(left, right.select("k", "top"), "k", hot, how)
            want = left.join(right.select("k", "top"), "k", how)
            assert sorted(map(str, got.select("k", "id", "top").collect())) == sorted(map(str, want.select("k", "id", "top").collect()))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = session.hot_join(left, right.select("k", "top"), "k", hot)
        worst = [r[-1] / max(1, r[len(r) // 2]) for r in task_rows(spark, lambda: joined.write.format("noop").mode("overwrite").save()) if len(r) >= 4 and sum(r) > 10_000]
        assert worst and max(worst) < 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_components_with_a_hub(spark, low_limits):
    hub = [(7, i) for i in range(10, 3000)]
    rest = [(i, i + 1) for i in range(5000, 5040)] + [(1, 7), (None, 3), (9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(hub + rest, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 7, *range(10, 3000))}, **{i: 5000 for i in range(5000, 5041)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
