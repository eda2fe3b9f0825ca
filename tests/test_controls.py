"""Shuffled controls: same neighbouring pairs and ends, every Eulerian path as likely as any other."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixmill.functions.hashing import control_seed, control_seed_of
from helixmill.operators.controls import shuffle_sequences, shuffled_controls


def pairs(s):
    return Counter(zip(s, s[1:]))


def test_invariants_and_independence_of_the_batch():
    rng = random.Random(1)
    seqs = ["".join(rng.choice(rng.choice(["ACGT", "AC", "ACGTN", "AAAAAAC"])) for _ in range(rng.choice([0, 1, 2, 3, 7, 50, 500]))) for _ in range(300)] + [None, "AAAA", "ACGT", "ACAC" * 30 + "G", "A" * 400 + "CGA"]
    names = [f"row_{i}" for i in range(len(seqs))]
    got = shuffle_sequences(seqs, names, 9)
    for s, g in zip(seqs, got):
        if g is not None:
            assert g != s and pairs(g) == pairs(s) and g[0] == s[0] and g[-1] == s[-1]
        elif s and len(s) >= 50:
            assert len(set(s)) == 1 or s == "ACAC" * 30 + "G" or len(set(s)) == 2
    assert [shuffle_sequences([s], [n], 9)[0] for s, n in zip(seqs[:60], names)] == got[:60]
    with pytest.raises(ValueError):
        shuffle_sequences(["ACGX"], ["row_1"], 1)


def test_paths_are_uniform():
    from itertools import permutations

    for s in ("ACATAGA", "ACGACTCA", "AACAGAAC"):
        want = {"".join(p) for p in permutations(s) if p[0] == s[0] and p[-1] == s[-1] and pairs(p) == pairs(s)}
        n = 3000
        got = Counter(shuffle_sequences([s] * n, [f"row_{i}" for i in range(n)], 3))
        assert set(got) == want - {s}
        mean = n / len(got)
        assert all(abs(k - mean) < 6 * mean**0.5 for k in got.values())


def test_seeds_and_frame(spark):
    df = spark.createDataFrame([(1, "ACGTACGTTGCA"), (1, "ACGTACGTTGCA"), (2, None), (3, "AC")], "row_index long, seq string").withColumn("control", F.lit("x"))
    assert int(df.select(control_seed(7, F.lit("row_1"), 2)).first()[0], 16) == control_seed_of(7, "row_1", 2)
    rows = shuffled_controls(df, 7).collect()
    assert len({r.control for r in rows if r.row_index == 1}) == 1 and [r.control for r in rows if r.row_index > 1] == [None, None]
    assert shuffled_controls(df.limit(0), 7).count() == 0
