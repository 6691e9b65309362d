"""Connected components over pair links of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from knotwork.operators.loop import cut_counting


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links`` (a, b): the least id reachable, itself included.

    Star contraction: in turn, every node hands its greater neighbours, then its smaller ones, to the least node it
    knows. Both are a minimum per node and a join, so no neighbourhood is ever gathered; the links become stars in a
    number of rounds that grows with the square of the logarithm at most. Self links are ignored.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = _counted(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, after = _counted(small.union(least).distinct())
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct()
    )


def _counted(edges: DataFrame) -> tuple[DataFrame, dict]:
    return cut_counting(edges, n=F.count("*"), mark=F.bit_xor(F.xxhash64("u", "v")))
