"""Shuffled control sequences with the same dinucleotides: Eulerian paths through the letters, drawn uniformly, a batch at a time.

A sequence is a path over its letters with a step per neighbouring pair. Such paths correspond to a tree of last exits (the step by
which each letter but the final one is left for good; they lead to the final letter) and an order of all other steps from each
letter. Over A, C, G, T and N there are at most 125 trees: one is drawn by the product of its steps' counts, the other steps get
random orders, and all sequences of a batch walk at the same time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.hashing import control_seed_of
from helixmill.functions.windows import mix64

ATTEMPTS = 50
LETTERS = b"ACGTN"
#: Letters of one matrix.
CELLS = 1 << 21
_V = len(LETTERS)
_CODE = np.full(256, 255, np.uint8)
_CODE[list(LETTERS)] = range(_V)
_TEXT = np.frombuffer(LETTERS, np.uint8)


@lru_cache(1)
def _trees() -> np.ndarray:
    """By final letter the trees: the letter that each letter is last left for; the final letter's own entry is itself."""
    out = []
    for root in range(_V):
        own = []
        for exits in product(range(_V), repeat=_V):
            if exits[root] != root or any(exits[v] == v for v in range(_V) if v != root):
                continue
            ends = list(range(_V))
            for _ in range(_V):
                ends = [exits[e] for e in ends]
            if all(e == root for e in ends):
                own.append(exits)
        out.append(own)
    return np.array(out)


def shuffle_matrix(codes: np.ndarray, size: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Row by row another random order with the same neighbouring pairs and ends. codes (n, longest), rows longest first and of
    three letters or more; size their lengths; seeds 64 bits a row, on which alone a row's result depends."""
    n, longest = codes.shape
    rows = np.arange(n)
    step = np.arange(longest - 1) < (size - 1)[:, None]
    a, b = codes[:, :-1].astype(np.int64), codes[:, 1:].astype(np.int64)
    count = np.bincount((rows[:, None] * _V * _V + a * _V + b)[step], minlength=n * _V * _V).reshape(n, _V, _V).astype(float)
    final = codes[rows, size - 1].astype(np.int64)
    weight = count.copy()
    idle = count.sum(2) == 0  # letters that are never left
    weight[rows[:, None], np.arange(_V), final[:, None]] += idle
    trees = _trees()[final]  # (n, trees, letters)
    chance = np.ones(trees.shape[:2])
    for v in range(_V):
        chance *= np.where((final == v)[:, None], 1.0, weight[rows[:, None], v, trees[:, :, v]])
    total = np.cumsum(chance, axis=1)
    u = (mix64(seeds, 1) >> np.uint64(11)) / 2.0**53 * total[:, -1]
    exits = trees[rows, np.minimum((total <= u[:, None]).sum(1), trees.shape[1] - 1)]
    # steps sorted by letter, in random order with the last exit at the end; a step is one number with the next letter in its low bits
    h = (mix64(seeds[:, None] + np.arange(longest - 1, dtype=np.uint64), 2) >> np.uint64(39)).astype(np.uint32)
    key = (a.astype(np.uint32) << 29) | (h << 3) | b.astype(np.uint32)
    for v in range(_V):
        own = step & (a == v) & (b == exits[:, v : v + 1]) & (final != v)[:, None]
        at = np.argmax(own, axis=1)  # any step of the kind will do, as long as the random numbers don't choose it
        has = own[rows, at]
        key[rows[has], at[has]] |= np.uint32(1 << 28)
    key[~step] = 0xFFFFFFFF
    key.sort(axis=1)
    after = (key & 7).astype(np.int64)
    leaves = count.sum(2).astype(np.int64)
    at = np.cumsum(leaves, axis=1) - leaves
    out = codes.copy()
    now = codes[:, 0].astype(np.int64)
    going = np.searchsorted(-size, -np.arange(longest), "left")  # rows longer than each place
    for t in range(1, longest):
        k = going[t]
        r, c = rows[:k], now[:k]
        place = at[r, c]
        at[r, c] = place + 1
        now = after[r, place]
        out[:k, t] = now
    return out


def shuffle_sequences(seqs: list[str | None], names: list[str], seed: int, attempts: int = ATTEMPTS) -> list[str | None]:
    """Of each sequence over A, C, G, T and N the first of `attempts` shuffles that differs; null if none does, so for any under three letters."""
    out: list[str | None] = [None] * len(seqs)
    open_ = sorted((i for i, s in enumerate(seqs) if s and len(s) > 2), key=lambda i: -len(seqs[i]))
    for attempt in range(attempts):
        again, lo = [], 0
        while lo < len(open_):
            part = open_[lo : lo + max(1, CELLS // len(seqs[open_[lo]]))]
            lo += len(part)
            size = np.array([len(seqs[i]) for i in part])
            text = np.full((len(part), size[0]), ord("A"), np.uint8)
            for k, i in enumerate(part):
                text[k, : size[k]] = np.frombuffer(seqs[i].encode("latin-1", "replace"), np.uint8)
            codes = _CODE[text]
            if (codes == 255).any():
                raise ValueError("a letter other than A, C, G, T and N")
            got = _TEXT[shuffle_matrix(codes, size, np.array([control_seed_of(seed, names[i], attempt) for i in part], np.uint64))]
            new = ((got != text) & (np.arange(size[0]) < size[:, None])).any(1)
            for k, i in enumerate(part):
                if new[k]:
                    out[i] = got[k, : size[k]].tobytes().decode()
                else:
                    again.append(i)
        open_ = again
    return out


def shuffled_controls(windows: DataFrame, seed: int, attempts: int = ATTEMPTS) -> DataFrame:
    """(row_index, control) of windows (row_index, seq): shuffle_sequences() of each.

    Each attempt's seed is a hash of seed, id and attempt, so controls depend on nothing else. Repeated rows get equal controls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [f"row_{i}" for i in b.column("row_index").to_pylist()]
            got = shuffle_sequences(b.column("seq").to_pylist(), names, seed, attempts)
            yield pa.RecordBatch.from_arrays([b.column("row_index"), pa.array(got, pa.string())], names=["row_index", "control"])

    return windows.select("row_index", "seq").mapInArrow(run, "row_index long, control string")


def control_invariants(windows: DataFrame, controls: DataFrame) -> DataFrame:
    """(n_controls, other_dinucleotides, other_ends, equal_sequences): how many controls break a rule; all but the first are 0."""
    x = windows.join(controls, "row_index")
    pairs = lambda c: F.array_sort(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(F.col(c), i, F.lit(2))))
    bad = lambda k: F.count(F.when(F.coalesce(k, F.lit(True)), 1))
    ends = (F.left("seq", F.lit(1)) != F.left("control", F.lit(1))) | (F.right("seq", F.lit(1)) != F.right("control", F.lit(1)))
    return x.agg(F.count("*").alias("n_controls"), bad(pairs("seq") != pairs("control")).alias("other_dinucleotides"), bad(ends).alias("other_ends"), bad(F.col("seq") == F.col("control")).alias("equal_sequences"))
