"""Reading cells to windows, packing, k-mers."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixmill.functions.windows import BAD, Windows, complement_kmers, pack, pack_cells, read_cell, reverse_complement, to_text, unpack, windows


@pytest.mark.parametrize(
    "cell,expected",
    [
        (None, ""), ("", ""), (" \n", ""), ("1000010000100001", "ACGT"), ("1000 0100\r\n00100001", "ACGT"), ("1100" "1000", "NA"), ("10000", "A"), ("100", ""), ("2000" "1000", "NA"),
        ("acguACGTN?", "ACGTACGTNN"), ("AC GT\n", "ACGT"), ("é1000", "N"), ("A1000100", "NC"),
    ],
)
def test_cells(cell, expected):
    assert to_text(read_cell(cell)) == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, BAD), max_size=60))
def test_pack(codes):
    c = np.array(codes, np.uint8)
    assert (unpack(pack(c)) == c).all()
    assert (reverse_complement(reverse_complement(c)) == c).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="01 ACGUn\n", max_size=40), st.text(alphabet="01", min_size=16, max_size=16)), max_size=12))
def test_batches_agree_with_cells(cells):
    for t in (pa.string(), pa.large_string()):
        a = pa.array(["skipped", *cells], t).slice(1)
        assert [to_text(unpack(w.as_py())) for w in pack_cells(a)] == [to_text(read_cell(c)) for c in cells]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ACGTN", max_size=50), max_size=4), st.sampled_from([8, 16, 32]))
def test_kmers(texts, k):
    w = Windows([pack(read_cell(t)) for t in texts])
    at, v = w.kmers(k)
    value = lambda s: sum("ACGT".index(c) << 2 * (k - 1 - i) for i, c in enumerate(s))
    expected = [(r, value(t[i : i + k])) for r, t in enumerate(texts) for i in range(len(t) - k + 1) if "N" not in t[i : i + k]]
    assert [(int(r), int(x)) for r, x in zip(w.row[at], v)] == expected
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    back = [value(turn(t[i : i + k])) for t in texts for i in range(len(t) - k + 1) if "N" not in t[i : i + k]]
    assert complement_kmers(v, k).tolist() == back


def test_records(spark):
    rows = [(1, "ACGT", "2025-01-02", 9), (1, "AAAA", "2025-01-01", 9), (2, None, None, 9), (None, "ACGT", None, 9), (2, None, None, 9)]
    df = spark.createDataFrame(rows, "row_index long, sequence string, loaded_at string, window int")
    got = {r.row_index: to_text(unpack(bytes(r.window))) for r in windows(df).collect()}
    assert got == {1: "AAAA", 2: ""}
    assert windows(df.limit(0)).count() == 0
