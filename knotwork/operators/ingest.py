"""Ingest of a batch of extraction payloads into nodes, edges, properties and provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from knotwork.functions.text import entity_id, slug
from knotwork.operators.extraction import plan_materialization, validate
from knotwork.operators.loop import keep_last, stored
from knotwork.operators.ontology import label_closure, type_roles
from knotwork.operators.temporal import upsert_edges, upsert_entities
from knotwork.sources.ontology import Ontology


@dataclass
class IngestLog:
    """Validated writes in arrival order; the graph tables are views over them."""

    nodes: DataFrame        # graph_id, id, label, type, source_doc, extraction_confidence, ord
    properties: DataFrame   # id, key, value, ord
    edges: DataFrame        # graph_id, source, type, target, weight, at, ord, event_id
    events: DataFrame       # id, graph_id, text, created_at, entity_count, relationship_count, dropped_count
    links: DataFrame        # event_id, entity_id
    dropped: DataFrame      # doc_id, reason


def ingest_log(documents: DataFrame, onto: Ontology, graph_id: str) -> IngestLog:
    """Writes of documents ``(doc_id, payload, text, source_doc, at)``.

    An inlined value is written on the entity it is attached to; if that entity is itself inlined
    there is no node to write on, and the value is reported as dropped.
    """
    entities, relationships, dropped = validate(documents.select("doc_id", "payload"), onto)
    roles = type_roles(entities.select("type"), label_closure(onto))
    plan = stored(plan_materialization(entities, relationships, roles))
    graph, event = F.lit(graph_id), F.concat(F.lit(f"{graph_id}:evt-"), F.col("doc_id").cast("string"))
    # Merged: Spark takes what was read from compressed files for small enough to broadcast.
    about = documents.select("doc_id", "source_doc", "at").hint("merge")
    policy = plan.select("doc_id", "name", "policy", "attach_to")
    kept = entities.join(policy.filter(F.col("policy") == "node").select("doc_id", "name").hint("merge"), ["doc_id", "name"], "left_semi").join(about, "doc_id")
    order = F.struct("at", "doc_id", "pos")
    nodes = kept.select(
        graph.alias("graph_id"), entity_id(graph, "name").alias("id"), F.col("name").alias("label"), "type", "source_doc",
        F.col("confidence").alias("extraction_confidence"), order.alias("ord"), event.alias("event_id"),
    )
    s = policy.select("doc_id", F.col("name").alias("source"), F.col("policy").alias("sp"), F.col("attach_to").alias("sa"))
    t = policy.select("doc_id", F.col("name").alias("target"), F.col("policy").alias("tp"), F.col("attach_to").alias("ta"))
    routed = relationships.join(s.hint("merge"), ["doc_id", "source"]).join(t.hint("merge"), ["doc_id", "target"]).join(about, "doc_id")
    into_source = (F.col("tp") == "property") & (F.col("ta") == F.col("source"))
    into_target = (F.col("sp") == "property") & (F.col("sa") == F.col("target"))
    routed = stored(routed.withColumn("route", F.when(into_source, "source").when(into_target, "target").otherwise("edge")))
    owner = F.when(F.col("route") == "source", F.col("source")).otherwise(F.col("target"))
    value = F.when(F.col("route") == "source", F.col("target")).otherwise(F.col("source"))
    owner_policy = F.when(F.col("route") == "source", F.col("sp")).otherwise(F.col("tp"))
    inlined = routed.filter(F.col("route") != "edge").withColumns({"owner": owner, "value": value, "owner_policy": owner_policy})
    properties = inlined.filter(F.col("owner_policy") == "node").select(
        entity_id(graph, "owner").alias("id"), F.col("relation").alias("key"), "value", F.struct("at", "doc_id", "pos").alias("ord")
    )
    lost = inlined.filter(F.col("owner_policy") != "node").select("doc_id", F.concat(F.lit("Value '"), "value", F.lit("' has no stored entity to attach to")).alias("reason"))
    edges = routed.filter(F.col("route") == "edge").select(
        graph.alias("graph_id"), entity_id(graph, "source").alias("source"), F.col("relation").alias("type"), entity_id(graph, "target").alias("target"),
        F.col("confidence").alias("weight"), "at", F.struct("doc_id", "pos").alias("ord"), event.alias("event_id"),
    )
    sizes = (
        entities.groupBy("doc_id").agg(F.count("*").alias("entity_count"))
        .join(relationships.groupBy("doc_id").agg(F.count("*").alias("relationship_count")), "doc_id", "full_outer")
        .join(dropped.groupBy("doc_id").agg(F.count("*").alias("dropped_count")), "doc_id", "full_outer")
    )
    events = documents.join(sizes.hint("merge"), "doc_id", "left").select(
        event.alias("id"), graph.alias("graph_id"), "text", F.col("at").alias("created_at"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("entity_count", "relationship_count", "dropped_count")],
    )
    links = nodes.select("event_id", F.col("id").alias("entity_id")).distinct()
    return IngestLog(nodes.drop("event_id"), properties, edges, events, links, dropped.unionByName(lost))


def current_nodes(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """Node table of a log of node and property writes."""
    rows = nodes.withColumns(
        {"salience": F.lit(1.0), "activation": F.lit(None).cast("double"), "derived": F.lit(False)}
    )
    last = keep_last(properties, ["id", "key"], ["ord"])
    maps = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("properties"))
    return upsert_entities(rows).join(maps, "id", "left").withColumn(
        "properties", F.coalesce("properties", F.expr("cast(map() as map<string,string>)"))
    )


def current_edges(edges: DataFrame, reopen: bool = False) -> DataFrame:
    """Edge table of a log of assertions. Node ids hold the slugs of the labels, so the edge id follows."""
    bare = F.substr("target", F.length("graph_id") + 2)
    return upsert_edges(edges, reopen).withColumn("id", F.concat("source", F.lit("->"), slug("type"), F.lit("->"), bare))


def ingest(documents: DataFrame, onto: Ontology, graph_id: str) -> tuple[DataFrame, DataFrame, IngestLog]:
    """Node and edge tables after a batch. The same documents again give the same tables."""
    log = ingest_log(documents, onto, graph_id)
    return current_nodes(log.nodes, log.properties), current_edges(log.edges), log
