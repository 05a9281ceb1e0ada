"""Connected components of a graph that stays distributed: alternating large-star and small-star steps.

A step needs each vertex's smallest neighbour only, which is aggregated before the shuffle, so no task gathers a
vertex's neighbours; the join that follows is a plain equi-join, whose heavy keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def _star(arcs: DataFrame) -> DataFrame:
    """For arcs (u, v): u with the smallest of its neighbours and itself."""
    return arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of any orderable type, undirected. Returns (vertex, root) for every vertex of an edge between two
    different ones: root is the smallest vertex that it reaches. No edges: no rows. Null ends count as no edge."""
    now = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.selectExpr("a AS u", "b AS v").union(now.selectExpr("b AS u", "a AS v"))
        large = both.join(_star(both), "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        down = large.selectExpr("b AS u", "a AS v")  # v < u
        least = _star(down)
        small = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.selectExpr("m AS a", "u AS b")).filter("a <> b").distinct()
        last, now = now, materialize(small)
        before, mark = mark, _mark(now)
        discard(last)
        if mark == before:
            break
    return now.selectExpr("b AS vertex", "a AS root").union(now.selectExpr("a AS vertex", "a AS root").distinct())
