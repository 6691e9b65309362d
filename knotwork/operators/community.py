"""Louvain communities."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F

from knotwork.operators.components import number_components
from knotwork.operators.loop import cut, cut_counting, keep_last


def undirected(edges: DataFrame) -> DataFrame:
    """Weighted arcs in both directions, one weight per pair of nodes; a loop once with twice its weight."""
    low, high = F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    pairs = keep_last(edges.select(low, high, "weight", "id"), ["a", "b"], ["id"]).select("a", "b", "weight")
    loops = pairs.filter(F.col("a") == F.col("b")).select("a", "b", (F.col("weight") * 2).alias("weight"))
    rest = pairs.filter(F.col("a") != F.col("b"))
    return rest.union(rest.select("b", "a", "weight")).union(loops)


def modularity(arcs: DataFrame, assigned: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of (id, community) on arcs in both directions."""
    of_a = assigned.select(F.col("id").alias("a"), F.col("community").alias("ca"))
    of_b = assigned.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    rows = arcs.join(of_a, "a").join(of_b, "b").groupBy(F.col("ca").alias("c")).agg(
        F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("total")
    )
    got = rows.agg(
        F.sum("inside").alias("i"), F.sum(F.col("total") * F.col("total")).alias("tt"), F.sum("total").alias("t")
    ).first()
    return 0.0 if not got["t"] else got["i"] / got["t"] - resolution * got["tt"] / (got["t"] * got["t"])


def _local_moves(arcs: DataFrame, assigned: DataFrame, resolution: float):
    """Rounds in which half of the nodes may move to the neighbour community with the best gain.

    Two rounds in turn free complementary halves. Ends after three idle rounds, among which every node had its chance;
    any other round raises modularity, so the end is reached.
    """
    degree = cut(arcs.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("k")))
    m2 = degree.agg(F.sum("k").alias("s")).first()["s"] or 0.0
    best = modularity(arcs, assigned, resolution)
    moved_any, idle = False, 0
    for turn in itertools.count():
        if not m2:
            break
        state = degree.join(assigned, "id")
        totals = state.groupBy("community").agg(F.sum("k").alias("tot"))
        to = assigned.select(F.col("id").alias("b"), F.col("community").alias("to"))
        links = arcs.filter(F.col("a") != F.col("b")).join(to, "b").groupBy(F.col("a").alias("id"), "to").agg(F.sum("weight").alias("w"))
        stay = state.select("id", F.col("community").alias("to"), F.lit(0.0).alias("w"))
        options = links.unionByName(stay).groupBy("id", "to").agg(F.sum("w").alias("w"))
        options = options.join(state, "id").join(totals.select(F.col("community").alias("to"), "tot"), "to")
        rest = F.col("tot") - F.when(F.col("to") == F.col("community"), F.col("k")).otherwise(0.0)
        gain = F.col("w") - F.lit(resolution) * F.col("k") * rest / F.lit(m2)
        here = F.max(F.when(F.col("to") == F.col("community"), gain)).alias("here")
        pick = options.groupBy("id", "community").agg(
            F.max_by(F.struct("to", gain.alias("g")), F.struct(gain.alias("g"), F.col("to"))).alias("top"), here
        )
        free = F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2
        go = free & (F.col("top.g") > F.col("here") + 1e-12)
        moved, seen = cut_counting(
            pick.select("id", F.when(go, F.col("top.to")).otherwise(F.col("community")).alias("community"), go.alias("go")),
            n=F.count_if("go"),
        )
        if seen["n"] == 0:
            idle += 1
            if idle > 2:
                break
            continue
        quality = modularity(arcs, moved, resolution)
        if quality <= best + 1e-9:
            idle += 1
            if idle > 2:
                break
            continue
        idle, best, moved_any = 0, quality, True
        assigned = moved.select("id", "community")
    return assigned, moved_any


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, community): local moves and contraction until modularity rests; numbered by least member id."""
    arcs = cut(undirected(edges))
    linked = arcs.select(F.col("a").alias("id")).distinct()
    member = cut(linked.select("id", F.col("id").alias("group")))
    level = arcs
    while True:
        start = cut(level.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")))
        assigned, moved = _local_moves(level, start, resolution)
        if not moved:
            break
        step = assigned.select(F.col("id").alias("group"), "community")
        member = cut(member.join(step, "group").select("id", F.col("community").alias("group")))
        a = assigned.select(F.col("id").alias("a"), F.col("community").alias("ca"))
        b = assigned.select(F.col("id").alias("b"), F.col("community").alias("cb"))
        level = cut(level.join(a, "a").join(b, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight")))
    least = member.groupBy("group").agg(F.min("id").alias("component"))
    named = member.join(least, "group").select("id", "component")
    alone = nodes.select("id").join(linked, "id", "left_anti").select("id", F.col("id").alias("component"))
    return number_components(cut(named.unionByName(alone))).select("id", F.col("component").alias("community"))


def detect_communities(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``community_id`` written back, and the members ordered by community and label."""
    from knotwork.sources.sinks import write_scores

    found = louvain(nodes, edges).select("id", F.col("community").alias("score"))
    written = write_scores(nodes, found, "community_id")
    return written, read_communities(written)


def read_communities(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("community_id").isNotNull()).select("id", "label", "community_id").orderBy("community_id", "label", "id")
