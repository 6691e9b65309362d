"""Filters on triples, vocabulary checks, validated manual rows, and graph view filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from knotwork.functions.text import edge_id, entity_id
from knotwork.operators.searches import join_few


def _has(column: str, text: str):
    return F.contains(F.lower(column), F.lit(text.lower()))


def filter_triples(triples: DataFrame, subject="", predicate="", obj="", kind: str = "all") -> DataFrame:
    """Contains filters on all three parts; ``kind`` is all, base or derived."""
    out = triples
    for column, text in (("subject", subject), ("predicate", predicate), ("object", obj)):
        if text:
            out = out.filter(_has(column, text))
    if kind == "base":
        out = out.filter(~F.col("derived"))
    elif kind == "derived":
        out = out.filter("derived")
    return out


def search_triples(triples: DataFrame, text: str) -> DataFrame:
    """Contains filter on any part."""
    return triples.filter(_has("subject", text) | _has("predicate", text) | _has("object", text)) if text else triples


def known_types(rows: DataFrame, column: str, vocabulary: DataFrame, known: bool = True) -> DataFrame:
    """Rows whose label is (or is not) in the vocabulary, in any case."""
    labels = vocabulary.select(F.lower("label").alias("_l")).distinct()
    how = "left_semi" if known else "left_anti"
    return rows.join(labels, F.lower(F.col(column)) == F.col("_l"), how)


def _known_flag(rows: DataFrame, column: str, vocabulary: DataFrame, flag: str) -> DataFrame:
    labels = vocabulary.select(F.lower("label").alias("_key"), F.lit(True).alias(flag)).distinct()
    return join_few(rows.withColumn("_key", F.lower(column)), labels, "_key").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_key")


def add_nodes(rows: DataFrame, classes: DataFrame, graph_id: str) -> DataFrame:
    """Manual nodes ``(label, type)`` with id, provenance and the reason if rejected."""
    out = _known_flag(rows, "type", classes, "_ok")
    return out.select(
        entity_id(F.lit(graph_id), "label").alias("id"), "label", "type",
        F.lit("manual-entry").alias("source_doc"), F.lit(1.0).alias("extraction_confidence"),
        F.when(~F.col("_ok"), F.concat(F.lit("unknown type: "), F.col("type"))).alias("rejected"),
    )


def add_edges(rows: DataFrame, properties: DataFrame, entities: DataFrame, graph_id: str) -> DataFrame:
    """Manual edges ``(source, relation, target)`` by node id; unknown relations and missing ends are rejected."""
    ends = entities.select("id", "label")
    out = _known_flag(rows, "relation", properties, "_ok")
    out = out.join(ends.select(F.col("id").alias("source"), F.col("label").alias("_s")), "source", "left").join(
        ends.select(F.col("id").alias("target"), F.col("label").alias("_t")), "target", "left"
    )
    reason = (
        F.when(~F.col("_ok"), F.concat(F.lit("unknown relation: "), F.col("relation")))
        .when(F.col("_s").isNull(), F.lit("source not found"))
        .when(F.col("_t").isNull(), F.lit("target not found"))
    )
    return out.select(
        edge_id(F.lit(graph_id), F.col("_s"), F.col("relation"), F.col("_t")).alias("id"),
        "source", "target", F.col("relation").alias("type"), F.lit(1.0).alias("weight"), reason.alias("rejected"),
    )


def add_rules(rows: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """Manual rules; types and relation must be known."""
    out = _known_flag(rows, "edge_type", properties, "_e")
    out = _known_flag(out, "source_type", classes, "_s")
    out = _known_flag(out, "target_type", classes, "_t")
    reason = (
        F.when(~F.col("_e"), F.concat(F.lit("unknown relation: "), F.col("edge_type")))
        .when(~F.col("_s"), F.concat(F.lit("unknown type: "), F.col("source_type")))
        .when(~F.col("_t"), F.concat(F.lit("unknown type: "), F.col("target_type")))
    )
    return out.select(*rows.columns, reason.alias("rejected"))


def implicit_fact_nodes(nodes: DataFrame, implicit_facts: DataFrame) -> DataFrame:
    """Nodes anchored by a pending or approved implicit fact."""
    ids = (
        implicit_facts.filter(F.col("status").isin("pending", "approved"))
        .select(F.explode("anchor_entity_ids").alias("id")).distinct()
    )
    return nodes.join(ids, "id", "left_semi")


def proof_edges(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges whose type occurs on a proof step."""
    types = facts.select(F.explode("proof_path").alias("p")).select(F.col("p.edge_type").alias("type")).distinct()
    return edges.join(types, "type", "left_semi")


def proof_nodes(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Ends of the proof edges."""
    return proof_edges(edges, facts).select(F.explode(F.array("source", "target")).alias("id")).distinct()
