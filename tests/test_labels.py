"""The packed cells' grammar, and the reader of records over it."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixmill.functions.labels import CellParser, label_values

NAMES = {"KIXQ4": 86, "WEZD2L": 31}
P = CellParser(NAMES)


def values(cell):
    return [v.value for v in P.read(cell)]


@pytest.mark.parametrize(
    "cell,expected",
    [
        ("25", [25]), ("-12", [-12]), ("+72", [72]), ("69; 114", [69, 114]), ("-28 -31", [-28, -31]), ("?,-67", [-67]), ('""-111""', [-111]), ('"""52"""', [52]),
        ("{-65}", [-65]), ("[-88; 114; -109]", [-88, 114, -109]), ('"91 rep 25, low depth"', [91]), ('"-50 (see note 24)"', [-50]), ('"+121 depth 28; re-run"', [121]), ("'-61 - weak; rep 10'", [-61]),
        ('"61 call 29|6"', [61]), ("'-88'、'-105'", [-88, -105]), ('"30" | "-44"', [30, -44]), ("'8,94'", [8, 94]), ("72||", [72]), (",,-41, -90,,", [-41, -90]), ("n/a,-018", [-18]), ("n/a | -7", [-7]),
        ("94.00;-24.0", [94, -24]), ("−42;–118", [-42, -118]), ("kixq4", [86]), ("-KIXQ4;wezd2l", [-86, 31]), ("31\n-50\n55", [31, -50, 55]), ('"51.0"|', [51]), ("NA;none;?", []), ("", []), ("   ", []), ('""', []),
        ("0;000;999;5;5;-5", [0, 0, 999, 5, 5, -5]), ("31；105|-46\t3/4", [31, 105, -46, 3, 4]), ('"-zaqp1 (see note 23)"', [None]), ("111;43;57;\"-50 (see note 24)\"", [111, 43, 57, -50]),
    ],
)
def test_cells(cell, expected):
    assert values(cell) == expected


def test_malformed():
    assert [tuple(v) for v in P.read('"12;-3')] == [(12, "bad_quote"), (-3, "bad_quote")]
    assert [v.flag for v in P.read("xyz;5")] == ["unreadable", None]
    assert values("9" * 5000) == [None]


def test_long_cells_take_linear_time():
    assert len(values("1 " * 200_000)) == 200_000
    assert values('"' * 100_001) == []
    assert len(values('"1";' * 50_000)) == 50_000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-300, 300), max_size=8), st.sampled_from([";", ", ", " | ", "/", "；", "\t", "、", " "]), st.sampled_from(["", '"', "'", '""']), st.booleans())
def test_round_trip(numbers, delim, quote, whole):
    cell = quote + delim.join(map(str, numbers)) + quote if whole else delim.join(f"{quote}{n}{quote}" for n in numbers)
    assert values(cell) == numbers


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789+-−;,|\"' ()[]{}ab/?.\n", max_size=40))
def test_never_crashes(cell):
    assert all(v.value is None or isinstance(v.value, int) for v in P.read(cell))


def test_records(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(1, "5;5;-7", t, "x"), (1, "5;5;-7", t + dt.timedelta(1), "x"), (2, None, t, None), (3, "  ", None, None), (None, "4", t, "y"), (4, "12", None, "z"), (4, "13", t, "z"), (5, "q", t, "z")]
    df = spark.createDataFrame(rows, "row_index long, labels string, loaded_at timestamp, pos string")
    got = sorted((r.row_index, r.pos, r.label_value, r.flag) for r in label_values(df, NAMES).collect() if r.pos)
    # a delivery without a time counts as the first
    assert got == [(1, 1, 5, None), (1, 2, 5, None), (1, 3, -7, None), (4, 1, 12, None)]
    assert [r.flag for r in label_values(df, NAMES).where("pos is null").collect()] == ["unreadable"]
    assert label_values(df.limit(0), NAMES).count() == 0


def test_deep_nesting(parser=CellParser(NAMES)):
    deep = "[" * 60 + "5; -7" + "]" * 60
    assert [v.value for v in parser.read(deep)] == [5, -7]
    assert [v.value for v in parser.read("1;(2;(3;(4;(5;(6;(7;(8;(9;(10)))))))))")] == list(range(1, 11))
    assert [v.flag for v in parser.read("1;(" * 5000 + ")" * 5000)] == ["unreadable"]


def test_first_use(spark):
    df = spark.createDataFrame([(1, "5;5;-5;x;5"), (2, "5")], "row_index long, labels string")
    assert [(r.row_index, r.label_value) for r in label_values(df, NAMES).where("is_first").orderBy("row_index", "pos").collect()] == [(1, 5), (1, -5), (2, 5)]
