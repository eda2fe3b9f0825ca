"""Golden vectors of the alignment plan."""

import pytest

from helixmill.operators import alignment as A

SCHEMA = "ord long, query_name string, flag int, chrom string, pos1 int, mapq int, cigar string, nm int, as_score int"


def loci(spark, records, length):
    rows = [(i, "q", f, c, p, 60, cig, nm, s) for i, (f, c, p, cig, nm, s) in enumerate(records)]
    df = A.mapped_records(spark.createDataFrame(rows, SCHEMA))
    ids = spark.createDataFrame([("q", length)], "query_name string, total_query_bases int")
    l = A.candidate_loci(A.collinear_groups(A.aligned_blocks(df)), ids)
    return l, ids


def category(spark, records, length, hits=1):
    l, ids = loci(spark, records, length)
    h = spark.createDataFrame([("q", hits)], "query_name string, exact_hits long")
    return A.classify(l, ids, h).collect()[0]


@pytest.mark.parametrize(
    "records,length,hits,primary",
    [
        ([(0, "chr1", 101, "20=", None, None)], 20, 1, "exact_unique"),
        ([(0, "chr1", 101, "20=", None, None)], 20, 2, "high_conf_unique"),
        ([(0, "chr1", 201, "99=1X", None, None)], 100, 1, "high_conf_unique"),
        ([(0, "chr1", 201, "99=1X", None, None), (256, "chr5", 501, "90=10S", None, None)], 100, 1, "ambiguous"),
        ([(0, "chr1", 201, "80=20S", None, None)], 100, 1, "low_quality"),
        ([], 100, 0, "unmapped"),
        ([(0, "chr1", 101, "50S450M", 0, None)], 500, 0, "low_quality"),
    ],
)
def test_primary(spark, records, length, hits, primary):
    assert category(spark, records, length, hits).primary_category == primary


@pytest.mark.parametrize(
    "record,length,coverage,identity",
    [
        ((0, "chr1", 1, "500M", 5, None), 500, 1.0, 495 / 500),
        ((0, "chr1", 1, "480M20I", 20, None), 500, 1.0, 480 / 500),
        ((0, "chr1", 1, "250M20D250M", 20, None), 500, 1.0, 500 / 520),
        ((0, "chr1", 1, "50S450M", 0, None), 500, 0.9, 1.0),
        ((0, "chr1", 1, "500M", None, None), 500, 1.0, 1.0),
    ],
)
def test_coverage_and_identity(spark, record, length, coverage, identity):
    r = loci(spark, [record], length)[0].collect()[0]
    assert (r.coverage, r.identity) == (pytest.approx(coverage), pytest.approx(identity))


def test_blocks_join_into_one_locus(spark):
    r = loci(spark, [(0, "chr2", 1000, "50=50S", None, None), (2048, "chr2", 1101, "50H50=", None, None)], 100)[0].collect()
    assert [(x.n_blocks, x.coverage, x.identity, x.intron_lengths) for x in r] == [(2, 1.0, 1.0, "")]
    assert loci(spark, [(0, "chr2", 1000, "50=50S", None, None), (2048, "chr2", 900, "50H50=", None, None)], 100)[0].count() == 2


def test_reverse_template(spark):
    df = A.mapped_records(spark.createDataFrame([(0, "q", 16, "chr1", 501, 60, "10S10=", None, None)], SCHEMA))
    b = A.aligned_blocks(df).collect()[0]
    assert (b.t_start, b.t_end) == (0, 10)


def test_introns(spark):
    r = category(spark, [(0, "chr3", 2001, "50=200N50=", None, None)], 100)
    assert (r.splice_category, r.intron_lengths) == ("spliced_unique", "200")
    r = category(spark, [(0, "chr3", 1, "50M50S", 0, None), (2048, "chr3", 101, "50H50M", 0, None)], 100)
    assert (r.n_blocks, r.intron_lengths, r.splice_category) == (2, "", "unspliced_unique")


def test_rank(spark):
    l = loci(spark, [(0, "chr1", 1, "95M5S", 0, 90), (256, "chr2", 1, "100M", 0, 85)], 100)[0]
    assert l.where("rank = 1").collect()[0].chrom == "chr1"
    l = loci(spark, [(0, "chr1", 1, "100M", 0, 80), (0, "chr2", 1, "100M", 0, 95)], 100)[0]
    assert l.where("rank = 1").collect()[0].chrom == "chr2"


def test_overlap_counts_once(spark):
    r = loci(spark, [(0, "chr1", 1, "60M40S", 0, None), (2048, "chr1", 56, "55H45M", 0, None)], 100)[0].collect()
    assert [(x.aligned, x.n_blocks) for x in r] == [(100, 2)]


def test_near_tied(spark):
    assert category(spark, [(0, "chr1", 1, "100M", 0, 100), (256, "chr2", 1, "100M", 0, 93)], 100).near_tied == "0.1"


def test_repeated_records_count_once_and_two_places_are_ambiguous(spark):
    same = (0, "chr1", 1, "100M", 0, 100)
    assert category(spark, [same, same], 100).primary_category == "exact_unique"
    assert category(spark, [same, (256, "chr1", 1, "100M", 0, 100)], 100).primary_category == "ambiguous"
