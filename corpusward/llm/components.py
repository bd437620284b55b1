"""Connected components of a link table by alternating star contractions.

Every round is two grouped minima and two joins; nothing is gathered to one task.
Hot nodes are safe: minima combine on the map side, and the joins back to the
edges are plain equi-joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .tables import drop, stored


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v; edges may repeat."""
    if larger_only:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select(F.col("u").alias("centre"), F.least("u", "m").alias("m"))
    joined = both.join(low, both["u"] == low["centre"])
    if larger_only:  # each larger neighbour of u now hangs on u's minimum
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # each smaller neighbour of u, and u, hang on the minimum
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select(F.col("centre").alias("u"), F.col("m").alias("v"))
        )
    return moved.where(F.col("u") > F.col("v"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    Nulls and self-links are ignored; an empty link table gives an empty result.  ``links``
    is read twice, so it should be a written table.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    seen, written = None, False
    while True:
        # The mark of the edges (their number and a sum of their hashes) is taken as they are written.
        watch = Observation()
        after = _star(_star(edges, True), False).distinct()
        after = stored(after.observe(watch, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
        mark = (watch.get["n"], watch.get["x"])
        if written:
            drop(edges)
        edges, written = after, True
        if mark == seen:
            break
        seen = mark
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
