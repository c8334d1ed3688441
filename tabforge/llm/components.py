"""Connected components of a graph given as edges, by rounds of star contraction on DataFrames.

Alternates the two star operations: every node hands its larger neighbours, then its smaller ones, to its smallest neighbour.
Each round is two grouped minima and two joins over the edges that are left; a round's edges are checkpointed to
the shared folder (no driver copy, no growing lineage).  The rounds end when the edges stay as they are, after a
number of rounds logarithmic in practice.  AQE splits the joins at hot nodes; the minima are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node.  Loops and repeated
    edges don't matter; edges with a null end are left out."""
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = cut_lineage(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = cut_lineage(small.distinct())
        before, state = state, _state(e)
        if state == before:
            break
    member = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    found = member.unionByName(roots)
    return found.unionByName(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
