"""Scans of the stored graph: nodes, edges, triples, facts, events, rules, catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from knotwork.operators.loop import keep_first
from knotwork.operators.ranking import number_rows


def scan_nodes(entities: DataFrame, graph_id: str) -> DataFrame:
    """Nodes of one graph with the stored defaults filled in."""
    return entities.filter(F.col("graph_id") == graph_id).withColumns(
        {
            "salience": F.coalesce("salience", F.lit(1.0)),
            "derived": F.coalesce("derived", F.lit(False)),
            "properties": F.coalesce("properties", F.expr("cast(map() as map<string,string>)")),
            "note": F.coalesce("note", F.lit("")),
            "summary": F.coalesce("summary", F.lit("")),
        }
    )


def scan_edges(edges: DataFrame, entities: DataFrame, graph_id: str) -> DataFrame:
    """Current edges whose ends are both in the graph; a missing or zero weight counts as 1."""
    ids = entities.filter(F.col("graph_id") == graph_id).select("id")
    return (
        edges.filter((F.col("graph_id") == graph_id) & F.col("invalid_at").isNull())
        .join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        .withColumn("weight", F.when(F.col("weight").isNull() | (F.col("weight") == 0), 1.0).otherwise(F.col("weight")))
    )


def graph_catalogue(entities: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """Per graph: nodes, all edges and last ingest; graphs without events come first in the order."""
    nodes = entities.groupBy("graph_id").agg(F.count("*").alias("node_count"))
    links = edges.groupBy("graph_id").agg(F.count("*").alias("edge_count"))
    last = events.groupBy("graph_id").agg(F.max("created_at").alias("last_ingested_at"))
    return (
        nodes.join(links, "graph_id", "left").join(last, "graph_id", "left")
        .withColumn("edge_count", F.coalesce("edge_count", F.lit(0)).cast("bigint"))
        .orderBy(F.desc_nulls_first("last_ingested_at"), "graph_id")
    )


def triples(entities: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Stored current edges and derived facts by label; ``ord`` puts stored before derived."""
    names = entities.select("id", "label")
    src = names.select(F.col("id").alias("source"), F.col("label").alias("subject"))
    tgt = names.select(F.col("id").alias("target"), F.col("label").alias("object"))
    stored = edges.filter(F.col("invalid_at").isNull()).select(
        "source", "target", F.col("type").alias("predicate"), F.lit(False).alias("derived"),
        F.lit(1.0).alias("confidence"), F.concat(F.lit("0"), F.col("id")).alias("ord"),
    )
    derived = facts.filter(F.col("edge_type").isNotNull()).select(
        F.col("source_id").alias("source"), F.col("target_id").alias("target"),
        F.col("edge_type").alias("predicate"), F.lit(True).alias("derived"), "confidence",
        F.concat(F.lit("1"), F.col("id")).alias("ord"),
    )
    both = stored.unionByName(derived)
    return both.join(src, "source").join(tgt, "target").select(
        "subject", "predicate", "object", "derived", "confidence", "ord"
    )


def load_rules(spark, path: str, multi_line: bool = True) -> DataFrame:
    """Rules of a JSON file, an array or one object per line; a missing file raises.

    ``ord`` numbers the rules from 0 in the order of the file names and of the places in a file. An array is parsed
    whole; of a file with one object per line, a place is the partition and the row that Spark reads it in.
    """
    kind = (
        "id string, name string, edge_type string, source_type string, target_type string, "
        "threshold double, weight double, description string"
    )
    if multi_line:
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("_file"), "value")
        parsed = F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ': ', 1) for c in kind.split(', '))}>>", {"mode": "FAILFAST"})
        raw = whole.select("_file", F.posexplode(parsed).alias("_at", "r")).select("_file", F.col("_at").cast("bigint").alias("_at"), "r.*")
    else:
        read = spark.read.schema(kind).option("mode", "FAILFAST").json(path)
        raw = read.select("*", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    return number_rows(raw, [], ["_file", "_at"], "ord", start=0).drop("_file", "_at").withColumns(
        {"weight": F.coalesce("weight", F.lit(1.0)), "description": F.coalesce("description", F.lit("{source} -> {target}"))}
    )


def merge_rules(seed: DataFrame, custom: DataFrame) -> DataFrame:
    """Seed rules then custom rules; a custom rule of the same id replaces the seed in its place."""
    body = [c for c in seed.columns if c not in ("id", "ord")]
    s = seed.select("id", F.col("ord").alias("s_ord"), F.struct(*body).alias("s"))
    c = custom.select("id", F.col("ord").alias("c_ord"), F.struct(*body).alias("c"))
    both = s.join(c, "id", "full_outer").withColumn("r", F.coalesce("c", "s"))
    last_seed = seed.agg(F.coalesce(F.max("ord"), F.lit(0))).scalar()
    return both.select(
        "id", *[F.col(f"r.{b}").alias(b) for b in body],
        F.coalesce(F.col("s_ord"), F.col("c_ord") + last_seed).cast("bigint").alias("ord"),
    )


def facts_with_status(facts: DataFrame, fed_back: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """Stored facts with the fed-back flag and the review status filled in, oldest round first."""
    out = facts
    for name in ("fed_back", "review_status"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("boolean" if name == "fed_back" else "string"))
    if fed_back is not None:
        out = out.drop("fed_back").join(fed_back.select("id", F.lit(True).alias("fed_back")).distinct(), "id", "left")
    if reviews is not None:
        out = out.drop("review_status").join(reviews.select("id", F.col("status").alias("review_status")), "id", "left")
    return out.withColumns(
        {
            "fed_back": F.coalesce("fed_back", F.lit(False)),
            "review_status": F.coalesce("review_status", F.lit("pending")),
        }
    ).orderBy("iteration", "id")


def fact_texts(facts: DataFrame) -> DataFrame:
    return facts.select("fact", "confidence", "iteration", "id").orderBy(F.desc("iteration"), "id")


def list_events(events: DataFrame, text: str | None = None) -> DataFrame:
    """Ingest events, newest first, optionally only those whose text holds ``text``."""
    if text:
        events = events.filter(F.contains(F.lower("text"), F.lit(text.lower())))
    return events.orderBy(F.desc("created_at"), "id")


def latest_filing(filings: DataFrame) -> DataFrame:
    """The most recent filing per ticker and form; ``recency`` is the position in the newest-first list."""
    return keep_first(filings, ["ticker", "form"], ["recency"])


def record_ingest(events: DataFrame, produced: DataFrame, entities: DataFrame) -> DataFrame:
    """Links from ingest events to the entities they produced, existing entities only."""
    links = produced.select("event_id", F.explode("entity_ids").alias("entity_id")).distinct()
    known = entities.select(F.col("id").alias("entity_id"))
    return links.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi").join(
        known, "entity_id", "left_semi"
    )


def node_provenance(links: DataFrame, events: DataFrame) -> DataFrame:
    """Events behind each entity."""
    return links.join(events.withColumnRenamed("id", "event_id"), "event_id")


def newest_provenance(links: DataFrame, events: DataFrame) -> DataFrame:
    """All events behind each entity, numbered from the newest."""
    return number_rows(node_provenance(links, events), ["entity_id"], [F.desc("created_at"), F.asc("event_id")], "rank")


def event_entities(links: DataFrame) -> DataFrame:
    """The reverse: entities that each event produced."""
    return links.select("event_id", "entity_id").distinct()


def graph_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as text lines: section, sort key, line. Empty sections hold one placeholder."""
    names = nodes.select("id", "label")
    entity_lines = nodes.select(
        F.lit("Entities").alias("section"), F.col("id").alias("ord"),
        F.concat(F.lit("- "), "label", F.lit(" (id: "), "id", F.lit(", type: "), "type", F.lit(")")).alias("line"),
    )
    named = (
        edges.join(names.select(F.col("id").alias("source"), F.col("label").alias("s")), "source", "left")
        .join(names.select(F.col("id").alias("target"), F.col("label").alias("t")), "target", "left")
    )
    edge_lines = named.select(
        F.lit("Relationships").alias("section"), F.col("id").alias("ord"),
        F.concat(
            F.lit("- "), F.coalesce("s", "source"), F.lit(" --"), "type", F.lit("--> "), F.coalesce("t", "target")
        ).alias("line"),
    )
    empty = nodes.sparkSession.sql(
        "SELECT * FROM VALUES ('Entities', '', '(no entities)'), ('Relationships', '', '(no relationships)') "
        "t(section, ord, line)"
    )
    lines = entity_lines.unionByName(edge_lines)
    present = lines.select("section").distinct()
    return lines.unionByName(empty.join(present, "section", "left_anti"))


def store_profile(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct node types, relation types and property keys."""

    def kind(name, df):
        return df.distinct().select(F.lit(name).alias("kind"), F.col("name"))

    return (
        kind("type", entities.select(F.col("type").alias("name")))
        .unionByName(kind("relation", edges.select(F.col("type").alias("name"))))
        .unionByName(kind("property", entities.select(F.explode(F.map_keys("properties")).alias("name"))))
    )
