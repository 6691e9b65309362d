"""Node typing from neighbours and from features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from knotwork.operators.searches import PART, Links


def majority(votes: DataFrame) -> DataFrame:
    """Most frequent label per id with its share; the smaller label wins ties."""
    counted = votes.groupBy("id", "label").agg(F.count("*").alias("n"))
    return counted.groupBy("id").agg(
        F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"), (F.max("n") / F.sum("n")).alias("share")
    )


def majority_vote(nodes: DataFrame, edges: DataFrame, labels: DataFrame, most: int = PART) -> DataFrame:
    """Known labels stay at 1.0; others take the majority of their labelled neighbours, else unknown at 0.

    A labelled hub hands its label on in parts of ``most`` edges. Only edges of labelled nodes are looked at for
    parallel ones, which count once.
    """
    arcs = edges.select("source", "target")
    links = Links(arcs.union(arcs.select("target", "source")), most)
    met = links.meet(labels.select(F.col("id").alias("source"), "label"))
    votes = met.select("source", F.col("target").alias("id"), "label").distinct().select("id", "label")
    own = labels.select("id", F.col("label").alias("own"))
    voted = majority(votes.join(own, "id", "left_anti"))
    out = nodes.select("id").join(own, "id", "left").join(voted, "id", "left")
    known = F.col("own").isNotNull()
    return out.select(
        "id", F.coalesce("own", "label", F.lit("unknown")).alias("predicted_type"),
        F.when(known, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("confidence"),
    )
