"""Connected components of an edge table by alternating stars; no adjacency list is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_staged, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node that can be reached.

    Large star: every node hands its larger neighbours the smallest of its neighbourhood; small star: the same for the
    smaller ones.  Both are a minimum per node (combined before the shuffle) joined back to the edges, where a hot node
    is split by adaptive skew joins.  The rounds needed grow with the logarithm of the nodes; the loop ends when a round
    changes no edge.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = staged(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        mark = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_staged(now)
        now = nxt
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
