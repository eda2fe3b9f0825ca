"""Near-duplicates, overlaps and shared spans against brute force on small, skewed and dirty fixtures."""

import random

import numpy as np
import pytest

from helixmill.functions.windows import pack, read_cell, windows
from helixmill.llm import neardup, overlap, sketch, spans
from helixmill.llm.neardup import BKForest
from helixmill.llm.sketch import distance

SCHEMA = "row_index long, sequence string, split_name string, source string, loaded_at timestamp, window string, rep int"
TURN = str.maketrans("ACGTN", "TGCAN")


def edit(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[k] = rng.choice("ACGTN")
        elif kind == 1:
            s.insert(k, rng.choice("ACGT"))
        else:
            del s[k]
    return "".join(s)


def corpus(seed=5, n=40, hot=30):
    """Random windows, edited, shifted, turned and short ones, exact copies, and one element that a third of all hold."""
    rng = random.Random(seed)
    rand = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    element = rand(210)
    out = []
    for _ in range(n):
        s = rand(rng.choice([500, 500, 300, 120, 60, 30]))
        out.append(s)
        out += [edit(rng, s, rng.randrange(1, max(2, len(s) // 60))) for _ in range(rng.randrange(3))]
        if rng.random() < 0.3:
            out.append(s[len(s) // 8 :] + rand(len(s) // 8))
        if rng.random() < 0.3:
            out.append(edit(rng, s, 1).translate(TURN)[::-1])
        if rng.random() < 0.3:
            out.append(s[len(s) // 2 :] + s[: len(s) // 2])
    out += [rand(150) + element + rand(140) for _ in range(hot)]
    out += ["A" * k for k in (8, 9, 40)] + ["ACGTACGA", "ACGTACG", "", None, "N" * 200, "ACGT" * 100, "CGTA" * 100] + [out[0]] * 4
    splits = ["train", "Train ", "validation", " VAL", "test", None, ""]
    return [(i, s, rng.choice(splits), rng.choice(["a", "A ", None]), None, "clash", 1) for i, s in enumerate(out)] + [(0, out[0], "test", "a", None, "again", 1), (None, out[1], "train", "a", None, "", 1)]


def kmers(s):
    return {s[i : i + 8] for i in range(len(s or "") - 7) if "N" not in s[i : i + 8]}


def similar(a, b):
    return bool(a and b) and len(a & b) >= 0.6 * len(a | b) - 1e-9


def first(rows):
    seen = {}
    for r in rows:
        if r[0] is not None:
            seen.setdefault(r[0], []).append(r)
    # deliveries without a time: the smallest counts
    return {k: min(v, key=lambda r: (pack(read_cell(r[1])))) for k, v in seen.items()}


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def small_limits(monkeypatch):
    """Hot shards, blocks and salts at the size of the fixture."""
    monkeypatch.setattr(sketch, "HEAVY", 4)
    monkeypatch.setattr(sketch, "BLOCK", 8)
    monkeypatch.setattr(sketch, "CHUNK", 16)
    monkeypatch.setattr(sketch, "STRIPE", 2)


@pytest.fixture
def hot_limits(monkeypatch, small_limits):
    """Hot seeds in salted parts, and finer seeds for crowded shards, at the size of the fixture."""
    monkeypatch.setattr(sketch, "HOT_WINDOWS", 10)
    monkeypatch.setattr(sketch, "ONE_IN", 1)
    monkeypatch.setattr(sketch, "SALTS", 3)
    monkeypatch.setattr(sketch, "CROWD", 12)


@pytest.fixture(scope="module")
def brute_pairs(rows):
    sets = {k: kmers(r[1]) for k, r in first(rows).items()}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if similar(sets[a], sets[b])}


def test_pairs(df, brute_pairs):
    assert {tuple(r) for r in neardup.pairs(windows(df)).collect()} == brute_pairs


def test_pairs_in_blocks(df, brute_pairs, small_limits):
    assert {tuple(r) for r in neardup.pairs(windows(df)).collect()} == brute_pairs


def test_pairs_with_hot_seeds(df, brute_pairs, hot_limits):
    assert {tuple(r) for r in neardup.pairs(windows(df)).collect()} == brute_pairs


def test_repeat_in_a_tenth_of_the_windows(spark, hot_limits, monkeypatch):
    """A long repeat makes hot seeds; windows with it are crowded, and all similar pairs among them are found all the same."""
    monkeypatch.setattr(sketch, "CROWD", 40)
    rng = random.Random(21)
    repeat = "".join(rng.choice("ACGT") for _ in range(250))
    texts = ["".join(rng.choice("ACGT") for _ in range(500)) for _ in range(900)]
    for _ in range(60):
        s = "".join(rng.choice("ACGT") for _ in range(250))
        texts += [s + repeat, edit(rng, s, rng.randint(0, 12)) + repeat]
    sets = [kmers(s) for s in texts]
    want = {(a, b) for a in range(900, len(sets)) for b in range(a + 1, len(sets)) if similar(sets[a], sets[b])}
    df = windows(spark.createDataFrame(list(enumerate(texts)), "row_index long, sequence string"))
    got = {tuple(r) for r in neardup.pairs(df).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 40


def test_groups(df, brute_pairs, rows):
    got = {r.row_index: r for r in neardup.groups(windows(df)).collect()}
    degree = {}
    for a, b in brute_pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    assert {k: r.n_links for k, r in got.items()} == {k: degree.get(k, 0) for k, r in first(rows).items() if kmers(r[1])}
    assert all(got[a].group_row_index == got[b].group_row_index for a, b in brute_pairs)
    assert all(r.group_row_index <= r.class_row_index <= k for k, r in got.items())


@pytest.mark.parametrize("limits", [None, "small_limits", "hot_limits"])
def test_overlaps(df, rows, limits, request):
    if limits:
        request.getfixturevalue(limits)
    name = lambda s: {"train": "t", "training": "t", "validation": "e", "val": "e", "test": "e"}.get((s or "").strip().lower())
    split = {k: name(min((r[2] or "" for r in rows if r[0] == k), key=lambda x: x)) for k in {r[0] for r in rows} - {None}}
    sets = {k: kmers(r[1]) for k, r in first(rows).items()}
    turned = {k: kmers((r[1] or "").translate(TURN)[::-1]) for k, r in first(rows).items()}
    expected = {(min(a, b), max(a, b)) for a in sets for b in sets if split[a] == "t" and split[b] == "e" and (similar(sets[a], sets[b]) or similar(sets[a], turned[b]))}
    expected = {p for p in expected if 0 not in p}  # record 0 is delivered with two splits
    assert {tuple(r) for r in overlap.cross_split_pairs(df).collect() if 0 not in tuple(r)} == expected
    report = overlap.overlap_report(df).collect()
    hit = {x for p in expected for x in p if split[x] == "e"}
    assert abs(sum(r.n_overlapping for r in report) - len(hit)) <= 5 and {r.source for r in report} <= {"a", None}


@pytest.mark.parametrize("hot", [False, True])
def test_spans(df, rows, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(spans, "HOT", 3)
        monkeypatch.setattr(spans, "HITS", 5)
    texts = {k: r[1] or "" for k, r in first(rows).items()}
    owners = {}
    for k, s in texts.items():
        for i in range(len(s) - 149):
            if "N" not in s[i : i + 150]:
                owners.setdefault(s[i : i + 150], set()).add(k)
    expected = {}
    for k, s in texts.items():
        covered = {j for i in range(len(s) - 149) if len(owners.get(s[i : i + 150], ())) > 1 for j in range(i, i + 150)}
        if covered:
            expected[k] = len(covered)
    got = {r.row_index: r for r in spans.shared_lengths(windows(df)).collect()}
    assert {k: r.shared_nt for k, r in got.items() if r.shared_nt} == expected
    assert set(got) == set(texts) and all(r.n_bases == len(texts[k]) for k, r in got.items())


def test_empty(spark, df):
    none = df.limit(0)
    assert neardup.pairs(windows(none)).count() == 0 and neardup.groups(windows(none)).count() == 0
    assert overlap.cross_split_pairs(none).count() == 0 and overlap.overlap_report(none).count() == 0
    assert spans.shared_lengths(windows(none)).count() == 0


def test_very_long_window(spark):
    rng = random.Random(1)
    s = "".join(rng.choice("ACGT") for _ in range(300_000))
    df = spark.createDataFrame([(1, s), (2, s[1000:] + "ACGT" * 100), (3, s[:200])], "row_index long, sequence string")
    assert {tuple(r) for r in neardup.pairs(windows(df)).collect()} == {(1, 2)}
    got = {r.row_index: r.shared_nt for r in spans.shared_lengths(windows(df)).collect()}
    assert got == {1: 299_200, 2: 299_000, 3: 200}


def test_code_distance_bounds_set_distance():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 65536, rng.integers(1, 600))) for _ in range(30)]
    rows, values = np.repeat(np.arange(30), [len(x) for x in sets]), np.concatenate(sets)
    code = sketch.codes(rows, values, 30)
    for i in range(30):
        for j in range(30):
            assert distance(code[[i]], code[[j]])[0] <= len(np.setxor1d(sets[i], sets[j]))


def test_tree_search_equals_scan():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (6, 16)).astype(np.uint64)
    code = base[rng.integers(0, 6, 200)] ^ (np.uint64(1) << rng.integers(0, 63, (200, 16)).astype(np.uint64)) * (rng.random((200, 16)) < 0.5).astype(np.uint64)
    tree, member = np.sort(rng.integers(0, 9, 200)), rng.random(200) < 0.8
    f = BKForest(code, tree, member)
    for reach in (0, 7, 40, 2000):
        got = {(int(q), int(n)) for qs, ns, _ in f.search(np.arange(200), np.full(200, reach), 50) for q, n in zip(qs, ns)}
        want = {(q, n) for q in range(200) for n in range(200) if member[n] and tree[q] == tree[n] and distance(code[[q]], code[[n]])[0] <= reach}
        assert got == want


def test_equal_sets_have_one_class(spark):
    """A third of all records are copies, turned copies or rotations with one set of 8-mers: they make one class."""
    rng = random.Random(9)
    s = "".join(rng.choice("ACGT") for _ in range(500))
    rows = [(i, s if i % 3 == 0 else "".join(rng.choice("ACGT") for _ in range(500))) for i in range(600)]
    df = windows(spark.createDataFrame(rows, "row_index long, sequence string"))
    assert sketch.sketch(df).select("sig_a", "sig_b", "n8").distinct().count() == 401
    g = {r.row_index: (r.class_row_index, r.group_row_index, r.n_links) for r in neardup.groups(df).collect()}
    assert all(g[i] == ((0, 0, 199) if i % 3 == 0 else (i, i, 0)) for i in g)


def substituted(rng, s, places):
    s = list(s)
    for p in places:
        s[p] = rng.choice([c for c in "ACGT" if c != s[p]])
    return "".join(s)


def test_distant_relatives_of_a_hot_family(spark, monkeypatch):
    """The seeds common to a base and a distant variant are those that its whole family holds."""
    monkeypatch.setattr(sketch, "HEAVY", 4)
    rng = random.Random(11)
    base = "".join(rng.choice("ACGT") for _ in range(500))
    texts = [base] + [edit(rng, base, rng.randint(1, 3)) for _ in range(40)]
    texts += [substituted(rng, base, [min(499, max(0, int((i + 0.5) * 500 / 15) + rng.randint(-3, 3))) for i in range(15)]) for _ in range(300)]
    sets = [kmers(s) for s in texts]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if similar(sets[a], sets[b])}
    df = windows(spark.createDataFrame(list(enumerate(texts)), "row_index long, sequence string"))
    assert {tuple(r) for r in neardup.pairs(df).collect()} == want


def test_repeats_and_unlike_lengths(spark):
    """Windows beside many tandem copies of themselves, and tandem repeats with substitutions in one copy."""
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        s = "".join(rng.choice("ACGT") for _ in range(500))
        texts += [s, s * 20]
    for _ in range(200):
        unit = "".join(rng.choice("ACGT") for _ in range(70))
        s = (unit * 8)[:500]
        at = rng.randrange(6) * 70
        texts += [s, substituted(rng, s, [at + int((i + 0.5) * 70 / 4) for i in range(4)])]
    want = {(a, a + 1) for a in range(0, len(texts), 2) if similar(kmers(texts[a]), kmers(texts[a + 1]))}
    assert len(want) > 150
    rows = [(i, s, "train" if i % 2 else "test") for i, s in enumerate(texts)]
    df = spark.createDataFrame(rows, "row_index long, sequence string, split_name string")
    assert {tuple(r) for r in neardup.pairs(windows(df)).collect()} == want
    turned = spark.createDataFrame([(i, s.translate(TURN)[::-1] if i % 2 else s, x) for i, s, x in rows], "row_index long, sequence string, split_name string")
    assert {tuple(r) for r in overlap.cross_split_pairs(turned).collect()} == want


def test_small_sets_share_a_seed():
    """Whatever their size, sets of up to 64 8-mers and their partners of similarity 0.6 have a seed in common."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 65)] * 3:
        a = rng.choice(65536, n, replace=False)
        common = int(rng.integers(-(-6 * n // 10), n + 1))
        more = max(0, int(common / 0.6) - n)
        b = np.concatenate([a[:common], rng.integers(0, 65536, more)])
        sets = [np.unique(a), np.unique(b)]
        if not similar(*map(set, map(np.ndarray.tolist, sets))):
            continue
        sizes = np.array([len(x) for x in sets])
        for level in (sketch.COARSE, sketch.FINE) if n <= 16 else (sketch.COARSE,):
            r, k = sketch.seeds(np.repeat([0, 1], sizes), np.concatenate(sets), sizes, level)
            assert set(k[r == 0]) & set(k[r == 1])
