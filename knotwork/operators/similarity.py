"""Shared-neighbour similarity of nodes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from knotwork.operators.loop import forget, stored, stored_counting
from knotwork.operators.projection import neighbour_pairs
from knotwork.operators.ranking import dense_edges, dense_ids, number_rows
from knotwork.operators.searches import PART, Links


#: Neighbours that one row of a list may have.
CHUNK = 1 << 20
#: Pairs that a stretch of similar sets may always meet.
LEAST = 1 << 22


def _met(pairs: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, chunk, both, common) of each pair that shares neighbours, and their numbers (b, w).

    Neighbours are numbered and listed by node and chunk of numbers, so a pair carries a few bytes for each neighbour
    instead of a row, and a hub has as many lists as it takes. ``common`` leaves the pair itself out.
    """
    ends = pairs.select(F.col("u").alias("a")).union(pairs.select("v")).distinct()
    mine = stored(near.join(ends, "a", "left_semi"))
    numbers = stored(number_rows(mine.select("b").distinct(), [], ["b"], "w", start=0))
    chunk, place = F.floor(F.col("w") / CHUNK).cast("int"), (F.col("w") % CHUNK).cast("int")
    lists = stored(mine.join(numbers, "b").groupBy("a", chunk.alias("chunk")).agg(F.collect_list(place).alias("ws")))
    for end in ("u", "v"):
        pairs = pairs.join(numbers.select(F.col("b").alias(end), F.col("w").alias(f"_{end}")), end, "left")
    both = pairs.join(lists.select(F.col("a").alias("u"), "chunk", F.col("ws").alias("wu")), "u").join(
        lists.select(F.col("a").alias("v"), "chunk", F.col("ws").alias("wv")), ["v", "chunk"]
    ).withColumn("both", F.array_intersect("wu", "wv")).filter(F.size("both") > 0)
    own = F.array(*[F.when(F.floor(F.col(c) / CHUNK) == F.col("chunk"), (F.col(c) % CHUNK).cast("int")) for c in ("_u", "_v")])
    return both.select("u", "v", "chunk", "both", F.array_except("both", own).alias("common")), numbers


def shared_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, shared): number of common neighbours of the given pairs that have some, the pair itself left out."""
    met, _ = _met(stored(pairs.select("u", "v").distinct()), stored(neighbour_pairs(edges)))
    return met.groupBy("u", "v").agg(F.sum(F.size("common")).alias("shared")).filter(F.col("shared") > 0)


def _sizes(near: DataFrame) -> DataFrame:
    return near.groupBy("a").agg(F.count("*").alias("n"))


def jaccard_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Jaccard of the neighbour sets of given pairs (u, v); 0 if both are empty."""
    return _score(stored(pairs.select("u", "v").distinct()), stored(neighbour_pairs(edges)))


def _score(pairs: DataFrame, near: DataFrame) -> DataFrame:
    sizes = _sizes(near)
    shared = _met(pairs, near)[0].groupBy("u", "v").agg(F.sum(F.size("both")).alias("both"), F.sum(F.size("common")).alias("common"))
    out = (
        pairs.join(shared, ["u", "v"], "left")
        .join(sizes.select(F.col("a").alias("u"), F.col("n").alias("nu")), "u", "left")
        .join(sizes.select(F.col("a").alias("v"), F.col("n").alias("nv")), "v", "left")
        .na.fill(0, ["both", "common", "nu", "nv"])
    )
    union = F.col("nu") + F.col("nv") - F.col("both")
    return out.select("u", "v", F.when(union > 0, F.col("common") / union).otherwise(F.lit(0.0)).alias("score"))


def similar_pairs(edges: DataFrame, threshold: float = 0.5, most: int = PART, rows: int | None = None) -> DataFrame:
    """All pairs u < v with Jaccard at or above the threshold, without trying all pairs.

    Neighbours are ordered from rare to common. Two sets that are similar enough share one of the
    first ``n - ceil(t n) + 1`` of each, so only those heads are joined. What they can share
    beyond their heads is at most the longer tail, so most pairs drop out by their head count
    before the exact count. Heads meet within neighbouring size buckets alone, as sets of very unlike size are not
    similar; what meets on a neighbour that very many share is dealt into parts. With a threshold of 0 or less every
    pair would qualify.

    Nodes go by numbers, and the sets meet in stretches of ``u`` in which about ``rows`` pairs meet, as many as there
    are neighbours where none is given; the shuffle files of a stretch go before the next one.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    t = F.lit(float(threshold))
    named = stored(neighbour_pairs(edges))
    ids = dense_ids(named.select(F.col("a").alias("id")))
    numbered = dense_edges(named.select(F.col("a").alias("source"), F.col("b").alias("target")), ids)
    near, seen = stored_counting(numbered.select(F.col("source").alias("a"), F.col("target").alias("b")), n=F.count("*"))
    forget(named)
    sizes = _sizes(near)
    common = near.groupBy("b").agg(F.count("*").alias("f"))

    def tail(n: str) -> Column:
        return F.greatest(F.lit(0), F.ceil(t * F.col(n) - 1e-9) - 1)

    ranked = number_rows(near.join(common, "b"), ["a"], ["f", "b"], "pos").join(sizes, "a")
    # Sizes in a ratio of at least the threshold lie in the same bucket or in neighbouring ones.
    bucket = F.floor(F.ln("n") / math.log(1 / threshold) + 1e-9) if threshold < 1 else F.col("n")
    head = stored(ranked.filter(F.col("pos") <= F.col("n") - tail("n")).select("a", "b", "n", bucket.cast("bigint").alias("_k")))
    around = F.explode(F.array(F.col("_k") - 1, F.col("_k"), F.col("_k") + 1))
    counts = stored(head.groupBy("b", "_k").agg(F.count("*").alias("m")))
    others = counts.withColumn("_k", around).groupBy("b", "_k").agg(F.sum("m").alias("o"))
    meeting = counts.join(others, ["b", "_k"]).agg(F.coalesce(F.sum(F.col("m") * F.col("o")), F.lit(0))).first()[0]
    turns = max(1, math.ceil(meeting / 2 / (rows or max(seen["n"], LEAST))))
    source = F.struct("b", F.col("_k").alias("k")).alias("source")
    there = Links(head.select(source, F.col("a").alias("v"), F.col("n").alias("nv")), most)
    need, found = t / (t + 1) * (F.col("nu") + F.col("nv")) - 1e-9, []
    for turn in range(turns):
        here = head.filter(F.pmod("a", F.lit(turns)) == turn).withColumn("_k", around).select(source, F.col("a").alias("u"), F.col("n").alias("nu"))
        met = there.meet(here).filter((F.col("u") < F.col("v")) & (F.least("nu", "nv") >= t * F.greatest("nu", "nv") - 1e-9))
        met = met.groupBy("u", "v").agg(F.count("*").alias("c"), F.max("nu").alias("nu"), F.max("nv").alias("nv"))
        found.append(stored(met.filter(F.col("c") + F.greatest(tail("nu"), tail("nv")) >= need).select("u", "v")))
    there.drop()
    forget(head, counts)
    pairs = found[0]
    for part in found[1:]:
        pairs = pairs.unionByName(part)
    scored = _score(stored(pairs), near).filter(F.col("score") >= t)
    forget(*found)
    u, v = (ids.select(F.col("id").alias(f"_{c}"), F.col("n").alias(c)) for c in "uv")
    return scored.join(u, "u").join(v, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"), "score")


def adamic_adar(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sum of 1 / ln(degree) over the common neighbours of given pairs; a loop adds two to a degree."""
    near = stored(neighbour_pairs(edges))
    degree = near.groupBy(F.col("a").alias("w")).agg((F.count("*") + F.count_if(F.col("a") == F.col("b"))).alias("d"))
    value = F.sum(F.lit(1.0) / F.ln("d")).alias("score")
    pairs = stored(pairs.select("u", "v").distinct())
    met, numbers = _met(pairs, near)
    degree = numbers.join(degree.withColumnRenamed("w", "b"), "b").select("w", "d")
    each = met.select("u", "v", "chunk", F.explode("common").alias("_w")).select("u", "v", (F.col("chunk").cast("bigint") * CHUNK + F.col("_w")).alias("w"))
    got = each.join(degree, "w").groupBy("u", "v").agg(value)
    return pairs.join(got, ["u", "v"], "left").select("u", "v", F.coalesce("score", F.lit(0.0)).alias("score"))
