"""Bi-temporal edges and entity upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from knotwork.functions.text import edge_id
from knotwork.operators.loop import keep_last
from knotwork.operators.ranking import next_change

GROUP = ["graph_id", "source", "type"]


def upsert_edges(assertions: DataFrame, reopen: bool = False) -> DataFrame:
    """Edges after all assertions in time order.

    ``assertions``: graph_id, source, type, target, weight, at, ord, event_id. A new target for
    (source, type) closes the open edges to other targets. An edge keeps the time and event of
    its first assertion and takes the last weight. An edge that was closed stays closed; with
    ``reopen`` the last assertion of an edge opens it again.
    """
    changes = next_change(assertions, GROUP, ["at", "ord"], "target", "at", "_closed")
    by = F.struct("at", "ord")
    closing = F.max_by("_closed", by) if reopen else F.min_by("_closed", by)
    return changes.groupBy(*GROUP, "target").agg(
        F.max_by("weight", by).alias("weight"),
        F.min("at").alias("valid_at"),
        closing.alias("invalid_at"),
        F.min_by("event_id", by).alias("produced_by_event_id"),
    )


def with_edge_ids(edges: DataFrame) -> DataFrame:
    return edges.withColumn("id", edge_id("graph_id", "source", "type", "target"))


def upsert_entities(rows: DataFrame) -> DataFrame:
    """One row per id: label, type, source and confidence of the last write; salience, activation
    and derived flag of the first.

    ``rows``: graph_id, id, label, type, source_doc, extraction_confidence, salience, activation,
    derived, ord.
    """
    first = ["salience", "activation", "derived"]
    last = ["label", "type", "source_doc", "extraction_confidence"]
    by = F.col("ord")
    return rows.groupBy("graph_id", "id").agg(
        *[F.max_by(c, by).alias(c) for c in last],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), by)).alias(c) for c in first],
    ).withColumns(
        {"salience": F.coalesce("salience", F.lit(1.0)), "derived": F.coalesce("derived", F.lit(False))}
    )


def relationship_history(edges: DataFrame, source: str | None = None, type_: str | None = None) -> DataFrame:
    """Current and closed edges of a source and type, oldest first, edges without a start before all."""
    if source is not None:
        edges = edges.filter(F.col("source") == source)
    if type_ is not None:
        edges = edges.filter(F.col("type") == type_)
    return edges.orderBy(F.asc_nulls_first("valid_at"), "target")


def current_state(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("invalid_at").isNull())
