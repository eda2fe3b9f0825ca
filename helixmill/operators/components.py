"""Connected components by alternating large-star and small-star steps; to the driver come counts and the bounded list of hot nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.session import hot_join, hot_keys, materialize


def _with_low(pairs: DataFrame, n_rows: int) -> DataFrame:
    """pairs (u, v) with m, the smallest v of each u: a minimum with partial aggregation, joined back. Nodes of very many edges aren't shuffled for it."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return hot_join(pairs, low.select("u", "m"), "u", hot_keys(low, "u", n_rows))


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 200) -> DataFrame:
    """(node, component) of every node of an edge; component is the smallest node. Edges with a null end are left out.

    The number of steps grows with the logarithm of the number of nodes; `most` only ends a faulty run.
    """
    e = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    last, n = None, e.count()
    for _ in range(most if n else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = _with_low(both, 2 * n).where("v > u")
        large = up.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        m = _with_low(large, n)
        small = m.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialize(small, "edges")
        state = tuple(e.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())
        if state == last:
            break
        last, n = state, state[0]
    else:
        if n:
            raise RuntimeError("components didn't settle")
    whole = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return whole.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
