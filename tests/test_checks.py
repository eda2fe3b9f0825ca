"""Checks of logs, probes, ledgers and batch losses."""

from helixmill.operators import checks, evaluation
from helixmill.operators.sampling import first_sources


def problems(spark, lines, **kw):
    return sorted((r.problem, r.value) for r in checks.index_log_problems(spark.createDataFrame([(x,) for x in lines], "line string"), **kw).collect())


def test_index_log(spark):
    good = "[M::mm_idx_stat] kmer size: 15; skip: 5; is_hpc: 0; #seq: 191"
    assert problems(spark, [good, "other"]) == []
    assert problems(spark, []) == [("no_index_line", None)] and problems(spark, [], building=False) == []
    assert problems(spark, [good, good]) == [("parts", "2")]
    assert problems(spark, [good, good.replace("15", "14")]) == [("disagree", "2"), ("parts", "2")]
    assert problems(spark, [good.replace("15", "14").replace("skip: 5", "skip: 10").replace("is_hpc: 0", "is_hpc: 1")]) == [("hpc", "1"), ("kmer", "14"), ("skip", "10")]
    assert problems(spark, [good, "[WARNING] Indexing parameters (-k, -w or -H) overridden by parameters used in the prebuilt index."], building=False) == [("overridden", "1")]
    assert problems(spark, ["For a multi-part index, no @SQ lines"], building=False) == [("parts", "1")]


def test_probes_ledger_loss_sources(spark):
    r = spark.createDataFrame([("a", "chr1", True), ("a", "chr2", False), ("b", "chr1", True), ("b", "chr1", True), ("c", "alien", True)], "query_name string, chrom string, is_primary boolean")
    e = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,), ("a",)], "query_name string")
    got = checks.probe_problems(r, e, spark.createDataFrame([("chr1",), ("chr1",)], "chrom string")).collect()
    assert sorted(map(tuple, got)) == [("b", "primary_records", 2), ("c", "foreign_contig", 1), ("d", "primary_records", 0)]
    assert [tuple(x) for x in checks.high_water(spark.createDataFrame([("s", 3), ("s", 9), ("s", 5)], "stage string, bytes long")).collect()] == [("s", 9)]
    b = spark.createDataFrame([(1, 1.0, 3), (1, 5.0, 1), (2, None, 4), (2, 2.0, 0)], "epoch int, loss double, n long")
    assert [tuple(x) for x in evaluation.epoch_loss(b).collect()] == [(1, 2.0, 4)]
    ids = spark.createDataFrame([("row_2",), ("row_10",), ("row_10",), (None,)], "sample_id string")
    assert [x[0] for x in first_sources(ids, 1).collect()] == ["row_10"]
