"""Entity resolution: similar entities by vector, then duplicates by type and label."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from knotwork.functions.text import labels_plausibly_same
from knotwork.functions.vectors import similarity_score
from knotwork.operators.loop import keep_first
from knotwork.operators.nearest import cosine_of, nearest, unit
from knotwork.operators.ontology import mark_subclass

SIMILAR_LIMIT = 10
MIN_SCORE = 0.5


def _farthest(min_score: float) -> float:
    """Distance of unit vectors at the given score, where score is (1 + cosine) / 2."""
    return (2.0 - 2.0 * (2.0 * min_score - 1.0)) ** 0.5 + 1e-9


def similar_entities(entities: DataFrame, limit: int = SIMILAR_LIMIT, min_score: float = MIN_SCORE) -> DataFrame:
    """(id, other_id, score, rank): the most similar entities of the same graph.

    ``entities``: graph_id, id, vector. The type does not matter here.
    """
    rows = unit(entities.withColumn("space", F.col("graph_id")), "vector")
    hits = nearest(rows, rows, limit, farthest=_farthest(min_score), same=True)
    return hits.select(
        F.col("left_id").alias("id"), F.col("right_id").alias("other_id"),
        similarity_score(cosine_of(F.col("distance"))).alias("score"), "rank",
    )


def duplicate_candidates(entities: DataFrame, closure: DataFrame, limit: int = SIMILAR_LIMIT, min_score: float = MIN_SCORE) -> DataFrame:
    """The best similar entity whose type fits in either direction and whose label is plausibly the same.

    ``entities``: graph_id, id, label, type, vector, and optionally derived; derived nodes are not
    checked but can be matched.
    """
    similar = similar_entities(entities, limit, min_score)
    info = entities.select("graph_id", "id", "label", "type")
    a = info.select("graph_id", "id", F.col("label").alias("new_label"), F.col("type").alias("new_type"))
    b = info.select(F.col("id").alias("other_id"), F.col("label").alias("existing_label"), F.col("type").alias("existing_type"))
    rows = similar.join(a, "id").join(b, "other_id")
    if "derived" in entities.columns:
        rows = rows.join(entities.filter(F.coalesce("derived", F.lit(False))).select("id"), "id", "left_anti")
    rows = rows.filter(labels_plausibly_same("new_label", "existing_label"))
    rows = mark_subclass(rows, "new_type", "existing_type", closure, "_ab")
    rows = mark_subclass(rows, "existing_type", "new_type", closure, "_ba").filter(F.col("_ab") | F.col("_ba"))
    best = keep_first(rows.select("graph_id", "id", "other_id", "score", "new_label", "existing_label", "rank"), ["id"], ["rank"])
    return best.select(
        F.concat_ws("-", F.lit("dup"), "graph_id", "id", "other_id").alias("candidate_id"), "graph_id",
        F.col("id").alias("new_entity_id"), "new_label", F.col("other_id").alias("existing_entity_id"), "existing_label",
        F.col("score").alias("similarity"),
    )
