"""Queries over the stored graph: scans, sinks, filters, joins, aggregates, windows, mining, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions import text
from knotwork.operators import counting, filters, mining, ontology, pattern, review, temporal
from knotwork.operators.loop import cut, keep_first, keep_last
from knotwork.operators.ranking import number_rows
from knotwork.plans.registry import query
from knotwork.plans.tpch_graph import GRAPH, KG_SQL, kg_sql, onto_sql
from knotwork.session import ensure_checkpoint_dir
from knotwork.sources import graph as src, sinks
from knotwork.sources.ontology import load_schema


# Facts stored for the scans: every customer's and supplier's domicile, in a round that its nation's number gives.
def stored_facts(g):
    kg = g.place_edges.filter(F.col("type") == "is domiciled in").join(
        g.entities.select(F.col("id").alias("source"), F.col("label").alias("sl")), "source"
    ).join(g.entities.select(F.col("id").alias("target"), F.col("label").alias("tl")), "target")
    step = F.struct(
        F.lit("Organization Domiciled In").alias("rule_name"), F.col("type").alias("edge_type"),
        F.col("sl").alias("source_label"), F.col("tl").alias("target_label"),
        F.lit(0.5).alias("premise_activation"), F.lit(1).alias("iteration"), F.lit(None).cast("string").alias("type_resolution"),
    )
    number = F.substring_index("target", "-", -1).cast("int")
    return kg.select(
        F.lit(GRAPH).alias("graph_id"),
        F.concat(F.lit("fact-domiciled-in-"), "id").alias("id"), F.lit("domiciled-in").alias("rule_id"),
        F.lit("Organization Domiciled In").alias("rule_name"), F.col("source").alias("source_id"),
        F.col("target").alias("target_id"), F.col("id").alias("edge_id"),
        F.when(number % 2 == 0, F.col("type")).alias("edge_type"),
        F.concat("sl", F.lit(" is domiciled in "), "tl").alias("fact"), F.lit(0.5).alias("confidence"),
        (number % 3 + 1).alias("iteration"), F.array(step).alias("proof_path"),
        F.array(F.lit("domiciled-in")).alias("supporting_rule_ids"),
        F.array(F.concat(F.lit("fact-domiciled-in-"), "id")).alias("contributing_fact_ids"),
        F.when(number % 5 == 0, True).alias("fed_back"), F.when(number % 7 == 0, "confirmed").alias("review_status"),
    )


FACTS = """
facts AS (
  SELECT 'fact-domiciled-in-' || e.id AS id, 'domiciled-in' AS rule_id, e.source AS source_id, e.target AS target_id,
         CASE WHEN CAST(split_part(e.target, '-', 2) AS INT) % 2 = 0 THEN e.type END AS edge_type,
         s.label || ' is domiciled in ' || t.label AS fact, CAST(0.5 AS DOUBLE) AS confidence,
         CAST(split_part(e.target, '-', 2) AS INT) % 3 + 1 AS iteration,
         CASE WHEN CAST(split_part(e.target, '-', 2) AS INT) % 5 = 0 THEN true END AS fed_back,
         CASE WHEN CAST(split_part(e.target, '-', 2) AS INT) % 7 = 0 THEN 'confirmed' END AS review_status
  FROM edges e JOIN entities s ON s.id = e.source JOIN entities t ON t.id = e.target
  WHERE e.type = 'is domiciled in')"""

TRIPLES = """
triples AS MATERIALIZED (
  SELECT s.label AS subject, e.type AS predicate, t.label AS object, false AS derived,
         CAST(1.0 AS DOUBLE) AS confidence, '0' || e.id AS ord
  FROM edges e JOIN entities s ON s.id = e.source JOIN entities t ON t.id = e.target
  UNION ALL
  SELECT s.label, f.edge_type, t.label, true, f.confidence, '1' || f.id
  FROM facts f JOIN entities s ON s.id = f.source_id JOIN entities t ON t.id = f.target_id
  WHERE f.edge_type IS NOT NULL)"""


def triples(g):
    return src.triples(g.entities, g.edges, stored_facts(g))


# Ingest history: one event per order, producing its customer and suppliers.
def ingest_events(g):
    return g.table("orders").select(
        F.concat(F.lit("evt-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.lit(GRAPH).alias("graph_id"), F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("Order of "), F.col("o_orderpriority")).alias("text"),
    )


def produced(g):
    n = g.node
    lines = g.table("lineitem").select("l_orderkey", n("supplier", "l_suppkey").alias("e"))
    buyers = g.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), n("customer", "o_custkey").alias("e"))
    ghosts = g.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(f"{GRAPH}:ghost").alias("e"))
    return lines.union(buyers).union(ghosts).distinct().groupBy("l_orderkey").agg(
        F.collect_list("e").alias("entity_ids")
    ).select(F.concat(F.lit("evt-"), F.col("l_orderkey").cast("string")).alias("event_id"), "entity_ids")


LINKS = f"""
links AS (
  SELECT DISTINCT 'evt-' || l_orderkey AS event_id, '{GRAPH}:supplier-' || l_suppkey AS entity_id FROM lineitem
  UNION SELECT 'evt-' || o_orderkey, '{GRAPH}:customer-' || o_custkey FROM orders)"""


@query("S1_scan_nodes", kg_sql(
    "SELECT id, label, type, source_doc, CAST(1.0 AS DOUBLE) AS salience, false AS derived, '' AS note FROM entities"))
def scan_nodes(g):
    return src.scan_nodes(g.entities, GRAPH).select("id", "label", "type", "source_doc", "salience", "derived", "note")


@query("S2_scan_edges", kg_sql("SELECT id, source, target, type, weight FROM edges"))
def scan_edges(g):
    return src.scan_edges(g.edges, g.entities, GRAPH).select("id", "source", "target", "type", "weight")


def catalogue_inputs(g):
    nodes = g.entities.select("source_doc", "id").withColumnRenamed("source_doc", "graph_id")
    links = g.edges.select(F.regexp_extract("source", ":([a-z]+)-", 1).alias("graph_id"), "id")
    events = g.table("orders").select(F.lit("customer").alias("graph_id"), F.col("o_orderdate").alias("created_at"))
    return nodes, links, events


CATALOGUE = kg_sql("""
SELECT n.graph_id, n.node_count, coalesce(l.edge_count, 0) AS edge_count, e.last_ingested_at
FROM (SELECT source_doc AS graph_id, count(*) AS node_count FROM entities GROUP BY 1) n
LEFT JOIN (SELECT regexp_extract(source, ':([a-z]+)-', 1) AS graph_id, count(*) AS edge_count FROM edges GROUP BY 1) l
  ON l.graph_id = n.graph_id
LEFT JOIN (SELECT 'customer' AS graph_id, max(o_orderdate) AS last_ingested_at FROM orders) e ON e.graph_id = n.graph_id""")


@query("S3_graph_catalogue", CATALOGUE)
def graph_catalogue(g):
    return src.graph_catalogue(*catalogue_inputs(g))


@query("J8_optional_counts", kg_sql("""
SELECT n.id, coalesce(e.n, 0) AS out_edges FROM entities n
LEFT JOIN (SELECT source, count(*) AS n FROM edges GROUP BY 1) e ON e.source = n.id"""))
def optional_counts(g):
    out = g.edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    return g.entities.select("id").join(out, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("out_edges"))


TRIPLE_ROWS = kg_sql("SELECT subject, predicate, object, derived, confidence FROM triples", FACTS, TRIPLES)


@query("S4_triples", TRIPLE_ROWS)
def triple_view(g):
    return triples(g).drop("ord")


@query("U1_union_triples", kg_sql(
    "SELECT predicate, derived, count(*) AS triples FROM triples GROUP BY 1, 2", FACTS, TRIPLES))
def union_triples(g):
    return triples(g).groupBy("predicate", "derived").agg(F.count("*").alias("triples"))


SUPPORT = """
support AS (
  SELECT e.type AS edge_type, s.type AS source_type, t.type AS target_type, count(*) AS support
  FROM edges e JOIN entities s ON s.id = e.source JOIN entities t ON t.id = e.target GROUP BY 1, 2, 3),
confidence AS (
  SELECT *, support / sum(support) OVER (PARTITION BY source_type) AS confidence FROM support)"""


def mined_rule_rows(g):
    found = counting.combo_confidence(counting.combo_support(g.edges, g.entities))
    return found.select(
        F.concat_ws("-", F.lit("r"), "edge_type", "source_type", "target_type").alias("id"),
        F.concat(F.lit("Rule "), "edge_type").alias("name"), "edge_type", "source_type", "target_type",
        F.lit(0.3).alias("threshold"),
        F.when(F.col("support") > 100, F.round("confidence", 6)).alias("weight"),
        F.when(F.col("support") > 100, F.lit("{source} x {target}")).alias("description"),
    )


@query("S5_load_rules", kg_sql("""
SELECT 'r-' || edge_type || '-' || source_type || '-' || target_type AS id, edge_type, source_type, target_type,
       CAST(0.3 AS DOUBLE) AS threshold,
       CASE WHEN support > 100 THEN round(confidence, 6) ELSE 1.0 END AS weight,
       CASE WHEN support > 100 THEN '{source} x {target}' ELSE '{source} -> {target}' END AS description,
       row_number() OVER (ORDER BY 'r-' || edge_type || '-' || source_type || '-' || target_type) - 1 AS ord
FROM confidence""", SUPPORT))
def rule_file(g):
    import uuid

    path = f"{ensure_checkpoint_dir(g.spark)}/rules-{uuid.uuid4().hex}"
    # One array in rule order; the rules are as many as there are triples of types.
    rows = mined_rule_rows(g)
    array = rows.agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in rows.columns if c != "id"]))).alias("rules"))
    array.select(F.to_json("rules").alias("value")).write.text(path)
    return src.load_rules(g.spark, path).select(
        "id", "edge_type", "source_type", "target_type", "threshold", "weight", "description", "ord"
    )


@query("S6_merge_rules", kg_sql("""
SELECT coalesce(c.id, s.id) AS id, coalesce(c.edge_type, s.edge_type) AS edge_type,
       CAST(CASE WHEN c.id IS NOT NULL THEN 0.9 ELSE 0.5 END AS DOUBLE) AS weight,
       CAST(CASE WHEN s.id IS NOT NULL THEN s.ord ELSE c.ord + (SELECT max(ord) FROM seed) END AS BIGINT) AS ord
FROM seed s FULL JOIN custom c ON c.id = s.id""", SUPPORT, """
seed AS (SELECT source_type || '>' || target_type AS id, min(edge_type) AS edge_type,
                row_number() OVER (ORDER BY source_type || '>' || target_type) AS ord FROM support GROUP BY source_type, target_type),
custom AS (SELECT source_type || '>' || target_type AS id, max(edge_type) AS edge_type,
                row_number() OVER (ORDER BY source_type || '>' || target_type) AS ord
           FROM support WHERE support > 100 GROUP BY source_type, target_type
           UNION ALL SELECT 'custom-extra', 'extra', 1000)"""))
def merge_rules(g):
    from knotwork.operators.ranking import number_rows

    support = cut(counting.combo_support(g.edges, g.entities))
    key = F.concat("source_type", F.lit(">"), "target_type").alias("id")

    def numbered(df, agg, weight):
        rows = df.groupBy(key).agg(agg("edge_type").alias("edge_type")).withColumn("weight", F.lit(weight))
        return number_rows(rows, ["weight"], ["id"], "ord").select("id", "edge_type", "weight", "ord")

    seed = numbered(support, F.min, 0.5)
    extra = g.spark.sql("SELECT 'custom-extra' id, 'extra' edge_type, double(0.9) weight, bigint(1000) ord")
    custom = numbered(support.filter("support > 100"), F.max, 0.9).unionByName(extra)
    return src.merge_rules(seed, custom).withColumn("ord", F.col("ord").cast("bigint"))


@query("S7_load_ontology", onto_sql("""
SELECT 'class' AS kind, uri, label, NULL::VARCHAR AS a, NULL::VARCHAR AS b FROM class_rows
UNION ALL SELECT 'property', uri, label, domain, range FROM property_rows
UNION ALL SELECT 'subclass', child_uri, NULL, parent_uri, NULL FROM sub_rows"""))
def load_ontology(g):
    o = load_schema(cut(g.rdf))
    none = F.lit(None).cast("string")
    return (
        o.classes.select(F.lit("class").alias("kind"), "uri", "label", none.alias("a"), none.alias("b"))
        .union(o.properties.select(F.lit("property"), "uri", "label", "domain", "range"))
        .union(o.subclass.select(F.lit("subclass"), "child_uri", none, "parent_uri", none))
    )


@query("S8_facts", kg_sql("""
SELECT id, rule_id, source_id, target_id, CAST(iteration AS BIGINT) AS iteration, coalesce(fed_back, false) AS fed_back,
       coalesce(review_status, 'pending') AS review_status, CAST(1 AS BIGINT) AS proof_steps FROM facts""", FACTS))
def facts_scan(g):
    return src.facts_with_status(stored_facts(g)).select(
        "id", "rule_id", "source_id", "target_id", F.col("iteration").cast("bigint").alias("iteration"), "fed_back",
        "review_status", F.size("proof_path").cast("bigint").alias("proof_steps"),
    )


@query("S9_fact_texts", kg_sql("SELECT id, fact, confidence, CAST(iteration AS BIGINT) AS iteration FROM facts", FACTS))
def fact_texts(g):
    return src.fact_texts(stored_facts(g)).withColumn("iteration", F.col("iteration").cast("bigint"))


@query("S10_ingest_events", """
SELECT 'evt-' || o_orderkey AS id, o_orderdate AS created_at, 'Order of ' || o_orderpriority AS text
FROM orders WHERE contains(lower('Order of ' || o_orderpriority), 'urgent')""")
def event_list(g):
    return src.list_events(ingest_events(g), "URGENT").select("id", "created_at", "text")


@query("S13_latest_filing", """
SELECT o_custkey AS ticker, o_orderpriority AS form, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS filing,
       max(o_orderdate) AS filed_at FROM orders GROUP BY 1, 2""")
def latest_filing(g):
    rows = g.table("orders").select(
        F.col("o_custkey").alias("ticker"), F.col("o_orderpriority").alias("form"), F.col("o_orderkey").alias("filing"),
        F.col("o_orderdate").alias("filed_at"),
        F.struct((-F.unix_timestamp("o_orderdate")).alias("t"), (-F.col("o_orderkey")).alias("k")).alias("recency"),
    )
    return src.latest_filing(rows).drop("recency")


DEGREE_SCORES = "scores AS (SELECT source AS id, CAST(count(*) AS DOUBLE) AS score FROM edges GROUP BY 1)"


def out_degree_scores(g):
    return g.edges.groupBy(F.col("source").alias("id")).agg(F.count("*").cast("double").alias("score"))


@query("S14_write_scores", kg_sql("""
SELECT n.id, s.score AS centrality_score FROM entities n LEFT JOIN scores s ON s.id = n.id""", DEGREE_SCORES))
def write_scores(g):
    return sinks.write_scores(g.entities, out_degree_scores(g), "centrality_score").select("id", "centrality_score")


@query("S15_apply_activation", kg_sql("""
SELECT n.id, CASE WHEN s.score IS NULL THEN NULL ELSE round(1.0 / (1.0 + s.score), 6) END AS activation
FROM entities n LEFT JOIN scores s ON s.id = n.id""", DEGREE_SCORES))
def apply_activation(g):
    act = out_degree_scores(g).select("id", F.round(F.lit(1.0) / (F.lit(1.0) + F.col("score")), 6).alias("activation"))
    ghost = act.select(F.concat(F.lit("ghost-"), "id").alias("id"), "activation")
    return sinks.apply_activation(g.entities, act.unionByName(ghost)).select("id", "activation")


def resaved(g):
    old = stored_facts(g)
    new = old.filter(F.col("iteration") == 2).withColumns(
        {"confidence": F.lit(0.75), "iteration": F.lit(9), "fed_back": F.lit(None).cast("boolean"), "review_status": F.lit(None).cast("string")}
    )
    return sinks.save_facts(old, new, g.entities)


@query("S16_save_facts", kg_sql("""
SELECT id, CASE WHEN iteration = 2 THEN 0.75 ELSE confidence END AS confidence,
       CAST(CASE WHEN iteration = 2 THEN 9 ELSE iteration END AS BIGINT) AS iteration,
       coalesce(fed_back, false) AS fed_back FROM facts""", FACTS))
def save_facts(g):
    return resaved(g)[0].select("id", "confidence", F.col("iteration").cast("bigint").alias("iteration"), "fed_back")


@query("S16_flag_derived", kg_sql("""
SELECT id, id IN (SELECT target_id FROM facts WHERE iteration = 2) AS derived FROM entities""", FACTS))
def flag_derived(g):
    return resaved(g)[1].select("id", "derived")


@query("S17_record_ingest", kg_sql("SELECT l.event_id, l.entity_id FROM links l JOIN entities e ON e.id = l.entity_id", LINKS))
def record_ingest(g):
    return src.record_ingest(ingest_events(g), produced(g), g.entities)


@query("S18_clear_activation", kg_sql("SELECT id, CAST(0.0 AS DOUBLE) AS activation FROM entities"))
def clear_activation(g):
    return sinks.clear_activation(g.entities).select("id", "activation")


@query("S18_clear_facts", kg_sql("""
SELECT id, type <> 'nation' OR id NOT IN (SELECT target_id FROM facts) AS derived FROM entities""", FACTS))
def clear_facts(g):
    nodes = g.entities.withColumn("derived", F.lit(True))
    return sinks.clear_facts(stored_facts(g), nodes, GRAPH)[1].select("id", "derived")


@query("S19_graph_text", kg_sql("""
SELECT 'Entities' AS section, '- ' || label || ' (id: ' || id || ', type: ' || type || ')' AS line FROM entities
UNION ALL SELECT 'Relationships', '- ' || s.label || ' --' || e.type || '--> ' || t.label
FROM edges e JOIN entities s ON s.id = e.source JOIN entities t ON t.id = e.target"""))
def graph_text(g):
    return src.graph_text(g.entities, g.edges).select("section", "line")


@query("S20_store_profile", kg_sql("""
SELECT DISTINCT 'type' AS kind, type AS name FROM entities UNION ALL SELECT DISTINCT 'relation', type FROM edges
UNION ALL SELECT * FROM (VALUES ('property', 'segment'), ('property', 'brand'), ('property', 'kind')) v"""))
def store_profile(g):
    return src.store_profile(g.entities, g.edges)


# Filters.

SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@query("F1_slugs", f"""
SELECT p_partkey AS key, {SLUG.format('p_name')} AS slug, 'g:' || {SLUG.format("p_name || '. ' || p_brand || ' É!'")} AS entity_id,
       'g:' || {SLUG.format('p_name')} || '->' || {SLUG.format('p_type')} || '->' || {SLUG.format('p_brand')} AS edge_id FROM part""")
def slugs(g):
    return g.table("part").select(
        F.col("p_partkey").alias("key"), text.slug("p_name").alias("slug"),
        text.entity_id(F.lit("g"), F.concat("p_name", F.lit(". "), "p_brand", F.lit(" É!"))).alias("entity_id"),
        text.edge_id(F.lit("g"), "p_name", "p_type", "p_brand").alias("edge_id"),
    )


@query("F2_filter_triples", kg_sql("""
SELECT subject, predicate, object, derived FROM triples
WHERE contains(lower(subject), 'customer') AND contains(lower(object), 'nation_1') AND derived""", FACTS, TRIPLES))
def filter_triples(g):
    return filters.filter_triples(triples(g), subject="CUSTOMER", obj="Nation_1", kind="derived").select(
        "subject", "predicate", "object", "derived"
    )


@query("F3_search_triples", kg_sql("""
SELECT subject, predicate, object, derived FROM triples
WHERE contains(lower(subject), 'nation_7') OR contains(lower(predicate), 'nation_7') OR contains(lower(object), 'nation_7')""", FACTS, TRIPLES))
def search_triples(g):
    return filters.search_triples(triples(g), "NATION_7").select("subject", "predicate", "object", "derived")


@query("F4_update_metadata", kg_sql("""
SELECT n.id, coalesce('balance ' || CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR), '') AS note,
       CAST(CASE WHEN c_acctbal > 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS salience,
       coalesce(c.c_mktsegment, CASE WHEN n.source_doc = 'part' AND n.type <> 'size band' THEN 'brand' END, '') AS first_property
FROM entities n LEFT JOIN customer c ON n.id = 'tpch:customer-' || c.c_custkey"""))
def update_metadata(g):
    balance = F.bround("c_acctbal").cast("bigint").cast("string")
    changes = g.table("customer").select(
        g.node("customer", "c_custkey").alias("id"), F.concat(F.lit("balance "), balance).alias("note"),
        F.when(F.col("c_acctbal") > 0, 0.5).alias("salience"), F.create_map(F.lit("seg"), F.col("c_mktsegment")).alias("properties"),
    )
    out = sinks.update_metadata(src.scan_nodes(g.entities, GRAPH), changes)
    first = F.coalesce(F.col("properties")["seg"], F.when(F.map_contains_key("properties", "brand"), "brand"), F.lit(""))
    return out.select("id", "note", "salience", first.alias("first_property"))


@query("F5_set_properties", kg_sql("""
SELECT n.id, coalesce(c_mktsegment, p_brand, '') AS first_value, coalesce(last, '') AS last_priority,
       CAST(CASE n.source_doc WHEN 'customer' THEN 1 WHEN 'part' THEN CASE WHEN p_brand IS NULL THEN 0 ELSE 2 END ELSE 0 END + CASE WHEN last IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_keys
FROM entities n LEFT JOIN customer ON n.id = 'tpch:customer-' || c_custkey LEFT JOIN part ON n.id = 'tpch:part-' || p_partkey LEFT JOIN (
  SELECT id, arg_max(v, o) AS last FROM (
    SELECT 'tpch:customer-' || o_custkey AS id, o_orderpriority AS v, (o_orderdate::VARCHAR, o_orderkey) AS o FROM orders
    UNION ALL SELECT DISTINCT 'tpch:supplier-' || l_suppkey, o_orderpriority, (o_orderdate::VARCHAR, o_orderkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1) l ON l.id = n.id"""))
def set_properties(g):
    orders, sold = g.table("orders"), g.table("lineitem").select("l_orderkey", "l_suppkey").distinct()
    sides = [
        orders.select(g.node("customer", "o_custkey").alias("id"), "o_orderpriority", "o_orderdate", "o_orderkey"),
        orders.join(sold, F.col("o_orderkey") == F.col("l_orderkey")).select(g.node("supplier", "l_suppkey").alias("id"), "o_orderpriority", "o_orderdate", "o_orderkey"),
    ]
    changes = sides[0].union(sides[1]).select(
        "id", F.lit("last").alias("key"), F.col("o_orderpriority").alias("value"), F.struct("o_orderdate", "o_orderkey").alias("ord"),
    )
    kept = F.col("properties")
    return sinks.set_properties(g.entities, changes).select(
        "id", F.coalesce(kept["segment"], kept["brand"], F.lit("")).alias("first_value"), F.coalesce(kept["last"], F.lit("")).alias("last_priority"),
        F.size("properties").cast("bigint").alias("n_keys"),
    )


@query("F6_fact_texts", kg_sql("""
SELECT e.id, replace(replace('{source} supplies {target}', '{source}', s.label), '{target}', t.label) AS fact
FROM edges e JOIN entities s ON s.id = e.source JOIN entities t ON t.id = e.target WHERE e.type = 'supplies'"""))
def fill_templates(g):
    names = g.entities.select("id", "label")
    return (
        g.edges.filter(F.col("type") == "supplies")
        .join(names.select(F.col("id").alias("source"), F.col("label").alias("s")), "source")
        .join(names.select(F.col("id").alias("target"), F.col("label").alias("t")), "target")
        .join(g.rules.select(F.col("edge_type").alias("type"), "description"), "type")
        .select("id", text.fill_template("description", "s", "t").alias("fact"))
    )


@query("F7_type_notes", kg_sql("""
SELECT DISTINCT r.id AS rule_id, s.type AS source_type, t.type AS target_type,
  nullif(concat_ws('; ', CASE WHEN lower(s.type) <> lower(r.source_type) THEN '"' || s.type || '" is-a "' || r.source_type || '"' END,
                   CASE WHEN lower(t.type) <> lower(r.target_type) THEN '"' || t.type || '" is-a "' || r.target_type || '"' END), '') AS note
FROM edges e JOIN entities s ON s.id = e.source JOIN entities t ON t.id = e.target JOIN rules r ON r.edge_type = e.type"""))
def type_notes(g):
    combos = counting.combo_support(g.edges, g.entities).drop("support")
    rules = g.rules.select(F.col("id").alias("rule_id"), "edge_type", F.col("source_type").alias("rs"), F.col("target_type").alias("rt"))
    return combos.join(rules, "edge_type").select(
        "rule_id", "source_type", "target_type", text.type_note("source_type", "rs", "target_type", "rt").alias("note")
    )


@query("F8_known_types", kg_sql("""
SELECT e.type, count(*) AS nodes, bool_or(lower(e.type) IN (SELECT lower(label) FROM class_rows)) AS known
FROM (SELECT type FROM entities UNION ALL SELECT upper(p_brand) FROM part) e GROUP BY 1""", onto=True))
def known_types(g):
    rows = g.entities.select("type").union(g.table("part").select(F.upper("p_brand")))
    yes = filters.known_types(rows, "type", g.ontology.classes).withColumn("known", F.lit(True))
    no = filters.known_types(rows, "type", g.ontology.classes, known=False).withColumn("known", F.lit(False))
    return yes.union(no).groupBy("type").agg(F.count("*").alias("nodes"), F.bool_or("known").alias("known"))


@query("F9_manual_rows", kg_sql("""
SELECT 'node' AS kind, c_name AS name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unknown type: robot' END AS rejected FROM customer
UNION ALL
SELECT 'edge', 'tpch:customer-' || o_custkey || '>' || 'tpch:supplier-' || (o_orderkey % 200),
  CASE WHEN o_orderstatus = 'P' THEN 'unknown relation: likes' WHEN s.s_suppkey IS NULL THEN 'target not found' END
FROM orders LEFT JOIN supplier s ON s.s_suppkey = o_orderkey % 200
UNION ALL
SELECT 'rule', edge_type || '/' || source_type || '/' || target_type,
  CASE WHEN support > 400 THEN 'unknown type: gadget' END FROM support""", SUPPORT))
def manual_rows(g):
    o = g.ontology
    nodes = g.table("customer").select(
        F.col("c_name").alias("label"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "robot").otherwise(F.concat(F.upper("c_mktsegment"), F.lit(" CUSTOMER"))).alias("type"),
    )
    edges = g.table("orders").select(
        g.node("customer", "o_custkey").alias("source"),
        F.when(F.col("o_orderstatus") == "P", "likes").otherwise("PURCHASES from").alias("relation"),
        F.concat(F.lit("tpch:supplier-"), (F.col("o_orderkey") % 200).cast("string")).alias("target"),
    )
    rules = counting.combo_support(g.edges, g.entities).select(
        "edge_type", "source_type", "target_type",
        F.when(F.col("support") > 400, "gadget").otherwise(F.col("target_type")).alias("t2"),
    )
    rules = rules.select("edge_type", "source_type", F.col("t2").alias("target_type"), F.col("target_type").alias("t"))
    return (
        filters.add_nodes(nodes, o.classes, GRAPH).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "rejected")
        .union(filters.add_edges(edges, o.properties, g.entities, GRAPH).select(F.lit("edge"), F.concat("source", F.lit(">"), "target"), "rejected"))
        .union(filters.add_rules(rules, o.classes, o.properties).select(F.lit("rule"), F.concat_ws("/", "edge_type", "source_type", "t"), "rejected"))
    )


def implicit_facts(g):
    """One implicit fact per order, anchored at its customer and the first supplier."""
    first = g.table("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"))
    return g.table("orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("imp-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.when(F.col("o_orderstatus") == "O", "approved").when(F.col("o_orderstatus") == "P", "pending").otherwise("rejected").alias("status"),
        F.array_compact(F.array(g.node("customer", "o_custkey"), g.node("supplier", "s"))).alias("anchor_entity_ids"),
    )


IMPLICIT = """
implicit AS (
  SELECT 'imp-' || o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'approved' WHEN 'P' THEN 'pending' ELSE 'rejected' END AS status,
         'tpch:customer-' || o_custkey AS a, 'tpch:supplier-' || s AS b
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1) f ON l_orderkey = o_orderkey)"""


@query("F10_implicit_fact_nodes", kg_sql("""
SELECT id, label FROM entities WHERE id IN (SELECT a FROM implicit WHERE status <> 'rejected' UNION SELECT b FROM implicit WHERE status <> 'rejected')""", IMPLICIT))
def implicit_fact_nodes(g):
    return filters.implicit_fact_nodes(g.entities, implicit_facts(g)).select("id", "label")


@query("J10_facts_with_anchors", kg_sql("""
SELECT i.id, status, coalesce(string_agg(e.label, '|' ORDER BY e.label), '') AS anchors
FROM (SELECT id, status, a AS x FROM implicit UNION ALL SELECT id, status, b FROM implicit) i
LEFT JOIN entities e ON e.id = i.x GROUP BY 1, 2""", IMPLICIT))
def facts_with_anchors(g):
    facts = implicit_facts(g)
    names = g.entities.select(F.col("id").alias("x"), "label")
    hits = facts.select("id", F.explode("anchor_entity_ids").alias("x")).join(names, "x")
    lists = hits.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("label")), "|").alias("anchors"))
    return facts.select("id", "status").join(lists, "id", "left").select("id", "status", F.coalesce("anchors", F.lit("")).alias("anchors"))


@query("F11_proof_nodes", kg_sql("""
SELECT DISTINCT x AS id FROM (SELECT source AS x, type FROM edges UNION ALL SELECT target, type FROM edges) WHERE type = 'is domiciled in'"""))
def proof_nodes(g):
    return filters.proof_nodes(g.edges, stored_facts(g))


@query("F11_proof_edges", kg_sql("SELECT id FROM edges WHERE type = 'is domiciled in'"))
def proof_edges(g):
    return filters.proof_edges(g.edges, stored_facts(g)).select("id")


# Joins and pattern queries.

@query("J1_pattern_single", kg_sql("""
SELECT subject, predicate, object, derived, arg_min(confidence, ord) AS confidence FROM triples
WHERE predicate = 'is domiciled in' AND lower(object) = 'nation_3' GROUP BY subject, predicate, object, derived""", FACTS, TRIPLES))
def pattern_single(g):
    rows, _ = pattern.run_query(triples(g), 'is domiciled in(X, "nation_3")')
    return rows


@query("J2_pattern_join", kg_sql("""
SELECT a.subject, a.predicate, a.object, coalesce(k.derived, false) AS derived, coalesce(k.confidence, 1.0) AS confidence
FROM triples a JOIN triples b ON lower(b.subject) = lower(a.object) JOIN triples c ON lower(c.subject) = lower(a.subject)
LEFT JOIN (SELECT subject, predicate, object, arg_min(derived, ord) AS derived, arg_min(confidence, ord) AS confidence
           FROM triples GROUP BY 1, 2, 3) k ON k.subject = a.subject AND k.predicate = a.predicate AND k.object = a.object
WHERE a.predicate = 'purchases from' AND b.predicate = 'is domiciled in' AND lower(b.object) = 'nation_3'
  AND c.predicate = 'is domiciled in'""", FACTS, TRIPLES))
def pattern_join(g):
    text_ = 'purchases from(X, Y), is domiciled in(Y, "NATION_3"), is domiciled in(X, Z)'
    rows, _ = pattern.run_query(cut(triples(g)), text_)
    return rows


@query("J2_pattern_bindings", kg_sql("""
SELECT a.subject, a.object, CAST(sum(b.n) * (SELECT count(*) FROM triples WHERE predicate = 'is located in') AS BIGINT) AS bindings
FROM triples a JOIN (SELECT lower(subject) AS s, count(*) AS n FROM triples WHERE predicate = 'supplies' GROUP BY 1) b ON b.s = lower(a.object)
WHERE a.predicate = 'purchases from' GROUP BY 1, 2""", FACTS, TRIPLES))
def pattern_bindings(g):
    atoms, _ = pattern.read_atoms("purchases from(X, Y), is located in(_, x), supplies(Y, Z)")
    return pattern.query_join(cut(triples(g)), atoms, expand=False).select("subject", "object", "bindings")


@query("J6_node_provenance", kg_sql("""
SELECT entity_id, event_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY o_orderdate DESC, event_id) AS BIGINT) AS rank
FROM links l JOIN entities e ON e.id = l.entity_id JOIN orders o ON 'evt-' || o_orderkey = l.event_id""", LINKS))
def node_provenance(g):
    links = src.record_ingest(ingest_events(g), produced(g), g.entities)
    return src.newest_provenance(links, ingest_events(g)).select("entity_id", "event_id", "rank")


@query("J6_event_entities", kg_sql("""
SELECT event_id, count(*) AS entities, min(entity_id) AS first_entity, max(entity_id) AS last_entity
FROM links l JOIN entities e ON e.id = l.entity_id JOIN orders o ON 'evt-' || o_orderkey = l.event_id GROUP BY 1""", LINKS))
def event_entities(g):
    links = src.record_ingest(ingest_events(g), produced(g), g.entities)
    return src.event_entities(links).groupBy("event_id").agg(
        F.count("*").alias("entities"), F.min("entity_id").alias("first_entity"), F.max("entity_id").alias("last_entity")
    )


@query("A15_ingest_totals", f"""
WITH {LINKS} SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS entities
FROM orders LEFT JOIN (SELECT event_id, count(*) + 1 AS n FROM links GROUP BY 1) l ON l.event_id = 'evt-' || o_orderkey""")
def ingest_totals(g):
    sizes = produced(g).select(F.col("event_id").alias("id"), F.size("entity_ids").alias("entity_count"))
    return counting.ingest_totals(ingest_events(g).join(sizes, "id", "left"))


# Aggregates.

@query("A1_combo_support", kg_sql("SELECT edge_type, source_type, target_type, support FROM support", SUPPORT))
def combo_support(g):
    return counting.combo_support(g.edges, g.entities)


@query("A2_combo_confidence", kg_sql(
    "SELECT edge_type, source_type, target_type, support, round(confidence, 6) AS confidence FROM confidence", SUPPORT))
def combo_confidence(g):
    return counting.combo_confidence(counting.combo_support(g.edges, g.entities)).withColumn("confidence", F.round("confidence", 6))


def firings(g):
    """Discounts of the lines of an order as independent signals."""
    return g.table("lineitem").select(
        F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("ord"),
        (F.col("l_discount") / 1.7).alias("c"), "l_partkey",
    )


@query("A3_noisy_or", """
SELECT l_orderkey AS key, round(least(1.0, 1.0 - product(1.0 - l_discount / 1.7)), 6) AS confidence FROM lineitem GROUP BY 1""")
def noisy_or(g):
    return counting.noisy_or(firings(g), "key", "c", "ord").withColumn("confidence", F.round("confidence", 6))


@query("A4_best_firing", """
SELECT l_orderkey AS key, l_discount / 1.7 AS c, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) = 1""")
def best_firing(g):
    return counting.best_firing(firings(g), "key", "c", "ord").drop("ord")


OUTCOMES = """
outcomes AS (SELECT 'rule-' || source AS rule_id, CASE WHEN quality = 1 THEN 'confirmed' ELSE 'rejected' END AS outcome, labels.doc_id AS ord
             FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"""


@query("A5_success_rate", f"""
WITH {OUTCOMES} SELECT rule_id, round(avg(CASE WHEN outcome = 'confirmed' THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS outcomes
FROM outcomes GROUP BY 1""")
def success_rate(g):
    return counting.success_rate(g.outcomes, "rule_id", F.col("outcome") == "confirmed").withColumn("rate", F.round("rate", 6))


@query("A6_fan_out", kg_sql("""
SELECT x AS name, count(*) AS fanout FROM (SELECT source AS x FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1"""))
def fan_out(g):
    return counting.fan_out(g.edges.select("source", "target"))


@query("A7_majority_label", kg_sql("""
SELECT id, label, round(n / sum(n) OVER (PARTITION BY id), 6) AS share
FROM (SELECT e.target AS id, s.type AS label, count(*) AS n FROM edges e JOIN entities s ON s.id = e.source GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1"""))
def majority_label(g):
    from knotwork.operators.typing import majority

    votes = g.edges.join(g.entities.select(F.col("id").alias("source"), F.col("type").alias("label")), "source")
    return majority(votes.select(F.col("target").alias("id"), "label")).withColumn("share", F.round("share", 6))


@query("A8_fire_counts", f"""
WITH {OUTCOMES}, fired AS (SELECT rule_id, count(*) AS fires FROM outcomes WHERE outcome = 'confirmed' GROUP BY 1)
SELECT 'rule-' || source AS rule_id, coalesce(any_value(fires), 0) AS fires, any_value(fires) IS NULL AS never_fired,
       coalesce(any_value(fires) < (SELECT avg(fires) FROM fired), false) AS under_activated
FROM documents LEFT JOIN fired ON rule_id = 'rule-' || source GROUP BY source""")
def fire_counts(g):
    from knotwork.operators.facts import rule_coverage

    rules = g.table("documents").select(F.concat(F.lit("rule-"), "source").alias("id")).distinct()
    return rule_coverage(rules, g.outcomes.filter(F.col("outcome") == "confirmed"))


@query("A11_community_members", kg_sql("SELECT CAST(split_part(target, '-', 2) AS BIGINT) AS community_id, count(*) AS members FROM edges WHERE type = 'is domiciled in' GROUP BY 1"))
def community_members(g):
    rows = g.edges.filter(F.col("type") == "is domiciled in").select(F.substring_index("target", "-", -1).cast("bigint").alias("community_id"))
    return counting.community_members(rows)


LOG = """
log AS (SELECT lower(event_type) AS repository, 'q' || (user_id % 40) AS question, 'p' || CAST(value AS BIGINT) || '(X, Y)' AS dsl,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS outcome,
               CASE WHEN value > 150 THEN true END AS liked, event_id AS ord FROM events)"""


def translation_log(g):
    return g.table("events").select(
        F.lower("event_type").alias("repository"), F.concat(F.lit("q"), (F.col("user_id") % 40).cast("string")).alias("question"),
        F.concat(F.lit("p"), F.bround("value").cast("bigint").cast("string"), F.lit("(X, Y)")).alias("dsl"),
        F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("outcome"),
        F.when(F.col("value") > 150, True).alias("liked"), F.col("event_id").alias("ord"),
    )


@query("A12_repeat_successes", f"""
WITH {LOG} SELECT repository, question, count(*) AS successes FROM log WHERE outcome = 'succeeded' GROUP BY 1, 2 HAVING count(*) >= 3""")
def repeat_successes(g):
    return counting.repeat_successes(translation_log(g))


@query("N1_fewshot", f"""
WITH {LOG}, often AS (SELECT repository, question FROM log WHERE outcome = 'succeeded' GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT repository, question, arg_max(dsl, ord) AS dsl FROM log
WHERE coalesce(liked, false) OR (outcome = 'succeeded' AND (repository, question) IN (SELECT (repository, question) FROM often)) GROUP BY 1, 2""")
def fewshot(g):
    return review.promote_fewshot(translation_log(g))


@query("A14_convergence_delta", kg_sql("""
SELECT round(max(abs(coalesce(a, 0) - coalesce(b, 0))), 6) AS delta
FROM (SELECT source AS id, 1.0 / count(*) AS a FROM edges GROUP BY 1) FULL JOIN (SELECT target AS id, 1.0 / count(*) AS b FROM edges GROUP BY 1) USING (id)"""))
def convergence_delta(g):
    def share(column):
        return g.edges.groupBy(F.col(column).alias("id")).agg((F.lit(1.0) / F.count("*")).alias("activation"))

    return counting.convergence_delta(share("source"), share("target")).withColumn("delta", F.round("delta", 6))


# Windows, sorts and set operations.

@query("W1_message_numbers", """
SELECT conv_id AS session, 'm-' || conv_id || '-' || turn AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS BIGINT) AS seq FROM conversations""")
def message_numbers(g):
    rows = g.messages.drop("seq").join(g.table("conversations").select(
        F.concat_ws("-", F.lit("m"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), (-F.col("turn")).alias("at")), "id")
    return review.number_messages(rows, ["at", "id"]).select(F.col("session_id").cast("bigint").alias("session"), "id", "seq")


@query("W2_last_messages", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS BIGINT) AS seq, role, text AS content FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def last_messages(g):
    return review.last_messages(g.messages, 3).select("session_id", "seq", "role", "content")


@query("W3_latest_write", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_min(value, (ts, event_id)) AS first_value FROM events GROUP BY 1""")
def latest_write(g):
    rows = g.table("events")
    by = ["ts", "event_id"]
    last = keep_last(rows.select("user_id", F.col("event_type").alias("last_type"), *by), ["user_id"], by).drop(*by)
    first = keep_first(rows.select("user_id", F.col("value").alias("first_value"), *by), ["user_id"], by).drop(*by)
    return last.join(first, "user_id")


def decisions(g):
    return g.table("events").select(
        F.concat(F.lit("item-"), F.col("user_id").cast("string")).alias("id"),
        F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected")
        .when(F.col("event_type") == "view", "maybe").otherwise("pending").alias("status"),
        F.col("ts").alias("reviewed_at"), F.col("event_id").alias("ord"),
    )


DECISIONS = """
decisions AS (SELECT 'item-' || user_id AS id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected'
                     WHEN 'view' THEN 'maybe' ELSE 'pending' END AS status, ts, event_id FROM events),
latest AS (SELECT id, arg_max(status, (ts, event_id)) AS status FROM decisions WHERE status <> 'maybe' GROUP BY 1)"""


@query("W4_latest_review", f"WITH {DECISIONS} SELECT id, status FROM latest")
def latest_review(g):
    return review.latest_decisions(decisions(g)).select("id", "status")


@query("V1_item_status", f"""
WITH {DECISIONS}, items AS (SELECT DISTINCT 'item-' || user_id AS id FROM events UNION SELECT 'item-c' || c_custkey FROM customer)
SELECT items.id, coalesce(status, 'pending') AS status FROM items LEFT JOIN latest ON latest.id = items.id""")
def item_status(g):
    users = g.table("events").select(F.concat(F.lit("item-"), F.col("user_id").cast("string")).alias("id")).distinct()
    others = g.table("customer").select(F.concat(F.lit("item-c"), F.col("c_custkey").cast("string")).alias("id"))
    return review.with_status(users.union(others), decisions(g))


@query("T1_ranked_nodes", kg_sql("""
SELECT s.id, coalesce(n.label, s.id) AS label, s.score FROM scores s LEFT JOIN entities n ON n.id = s.id""", DEGREE_SCORES))
def ranked_nodes(g):
    return counting.rank_nodes(out_degree_scores(g), g.entities).select("id", "label", "score")


@query("T2_top_activated", kg_sql("""
SELECT id, label, round(1.0 / n, 6) AS activation FROM entities JOIN (SELECT target, count(*) AS n FROM edges GROUP BY 1) d ON d.target = id
WHERE round(1.0 / n, 6) > 0.01 ORDER BY round(1.0 / n, 6) DESC, id LIMIT 10"""))
def top_activated(g):
    act = g.edges.groupBy(F.col("target").alias("id")).agg(F.round(F.lit(1.0) / F.count("*"), 6).alias("activation"))
    return counting.top_activated(sinks.apply_activation(g.entities, act)).select("id", "label", "activation")


@query("T3_review_queue", kg_sql("""
SELECT 'cand-' || edge_type || '-' || source_type || '-' || target_type AS id, round(confidence, 6) AS confidence
FROM confidence WHERE support >= 3""", SUPPORT))
def review_queue(g):
    found = counting.combo_confidence(counting.combo_support(g.edges, g.entities)).filter("support >= 3")
    items = found.select(F.concat_ws("-", F.lit("cand"), "edge_type", "source_type", "target_type").alias("id"), F.round("confidence", 6).alias("confidence"))
    return counting.review_queue(review.with_status(items, decisions(g))).select("id", "confidence")


COVERED = "covered AS (SELECT 'supplies' AS edge_type, 'supplier' AS source_type, min(lower(p_type)) || ' part' AS target_type FROM part)"


def covered(g):
    return mining.covered_combos(
        g.rules,
        g.table("part").select(F.lit("supplies").alias("edge_type"), F.lit("supplier").alias("source_type"), F.concat(F.lower("p_type"), F.lit(" part")).alias("target_type"))
        .groupBy("edge_type", "source_type").agg(F.min("target_type").alias("target_type")),
    )


@query("J9_uncovered_combos", kg_sql("""
SELECT edge_type, source_type, target_type FROM support WHERE (edge_type, source_type, target_type) NOT IN (SELECT (edge_type, source_type, target_type) FROM covered)""", SUPPORT, COVERED))
def uncovered_combos(g):
    return counting.combo_support(g.edges, g.entities).join(covered(g), mining.COMBO, "left_anti").drop("support")


@query("U2_covered_combos", kg_sql("""
SELECT edge_type, source_type, target_type FROM rules UNION SELECT edge_type, source_type, target_type FROM covered""", COVERED))
def covered_combos(g):
    return covered(g)


@query("U4_fired_rules", f"""
WITH {OUTCOMES} SELECT DISTINCT 'rule-' || source AS id, 'rule-' || source IN (SELECT rule_id FROM outcomes) AS fired FROM documents""")
def fired_rules(g):
    rules = g.table("documents").select(F.concat(F.lit("rule-"), "source").alias("id")).distinct()
    used = g.outcomes.select(F.col("rule_id").alias("id")).distinct()
    return rules.join(used, "id", "left_semi").withColumn("fired", F.lit(True)).union(
        rules.join(used, "id", "left_anti").withColumn("fired", F.lit(False))
    )


@query("U5_neighbours", kg_sql("""
SELECT a AS id, count(DISTINCT b) AS neighbours FROM (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges) GROUP BY 1"""))
def neighbours(g):
    from knotwork.operators.projection import neighbour_pairs

    return neighbour_pairs(g.edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("neighbours"))


@query("M1_mine_candidates", kg_sql("""
SELECT 'cand-' || edge_type || '-' || source_type || '-' || target_type AS id, edge_type, source_type, target_type, support, round(confidence, 6) AS confidence
FROM confidence WHERE support >= 3 AND confidence >= 0.1 AND (edge_type, source_type, target_type) NOT IN (SELECT (edge_type, source_type, target_type) FROM covered)""", SUPPORT, COVERED))
def mine_candidates(g):
    return mining.mine_candidates(g.entities, g.edges, covered(g), min_confidence=0.1).withColumn("confidence", F.round("confidence", 6))


@query("M2_promote_candidates", kg_sql("""
SELECT 'mined-cand-' || edge_type || '-' || source_type || '-' || target_type AS id, 'Mined: ' || edge_type AS name, edge_type, source_type, target_type,
       CAST(0.3 AS DOUBLE) AS threshold, round(confidence, 6) AS weight,
       '{source} ' || edge_type || ' {target} (mined, support=' || support || ')' AS description
FROM confidence WHERE support >= 3 AND confidence >= 0.6""", SUPPORT))
def promote_candidates(g):
    found = mining.mine_candidates(g.entities, g.edges, covered(g))
    items = found.withColumn("status", F.lit("approved"))
    return mining.promote(items).withColumn("weight", F.round("weight", 6))


# Bi-temporal edges and entity upserts.

BITEMPORAL = """
firsts AS (SELECT user_id, event_type, min(ts) AS t0, arg_max(value, (ts, event_id)) AS weight, arg_min(event_id, (ts, event_id)) AS e0
           FROM events GROUP BY 1, 2),
history AS (
  SELECT 'user-' || f.user_id AS source, f.event_type AS target, f.weight, f.t0 AS valid_at, 'evt-' || f.e0 AS produced_by_event_id,
         (SELECT min(e.ts) FROM events e WHERE e.user_id = f.user_id AND e.event_type <> f.event_type AND e.ts > f.t0) AS invalid_at
  FROM firsts f)"""


@query("B1_upsert_edges", f"WITH {BITEMPORAL} SELECT source, target, weight, valid_at, invalid_at, produced_by_event_id FROM history")
def upsert_edges(g):
    return temporal.upsert_edges(g.assertions).drop("graph_id", "type")


@query("J11_supersession", f"WITH {BITEMPORAL} SELECT source, target, invalid_at FROM history WHERE invalid_at IS NOT NULL")
def supersession(g):
    return temporal.upsert_edges(g.assertions).filter("invalid_at is not null").select("source", "target", "invalid_at")


@query("J7_relationship_history", f"""
WITH {BITEMPORAL} SELECT source, target, valid_at, invalid_at IS NULL AS current FROM history""")
def relationship_history(g):
    edges = temporal.upsert_edges(g.assertions)
    return temporal.relationship_history(edges, type_="last action").select(
        "source", "target", "valid_at", F.col("invalid_at").isNull().alias("current")
    )


@query("B3_timeline", f"WITH {BITEMPORAL} SELECT source, target, valid_at, CAST(row_number() OVER (PARTITION BY source ORDER BY valid_at NULLS FIRST, target) AS BIGINT) AS pos FROM history")
def timeline(g):
    edges = temporal.upsert_edges(g.assertions)
    return number_rows(edges, ["source"], ["valid_at", "target"], "pos").select("source", "target", "valid_at", "pos")


@query("B3_current_state", f"WITH {BITEMPORAL} SELECT source, target, valid_at FROM history WHERE invalid_at IS NULL")
def current_state(g):
    return temporal.current_state(temporal.upsert_edges(g.assertions)).select("source", "target", "valid_at")


@query("B2_upsert_entities", """
SELECT 'user-' || user_id AS id, arg_max(event_type, event_id) AS type, arg_min(value, event_id) AS salience FROM events GROUP BY 1""")
def upsert_entities(g):
    rows = g.table("events").select(
        F.lit(GRAPH).alias("graph_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("id"),
        F.col("event_type").alias("label"), F.col("event_type").alias("type"), F.lit("events").alias("source_doc"),
        F.lit(1.0).alias("extraction_confidence"), F.col("value").alias("salience"), F.lit(None).cast("double").alias("activation"),
        F.lit(None).cast("boolean").alias("derived"), F.col("event_id").alias("ord"),
    )
    return temporal.upsert_entities(rows).select("id", "type", "salience")


@query("K7_usage_confidence", """
SELECT source AS name, round(coalesce(avg(CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 0.25), 6) AS confidence
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def usage_confidence(g):
    docs = g.table("documents").select("doc_id", "source")
    catalogue = docs.select(F.col("source").alias("name")).distinct().withColumn("confidence", F.lit(0.25))
    usage = g.table("labels").join(docs, "doc_id").select(F.col("source").alias("skill"), (F.col("quality") == 1).alias("success"))
    return review.usage_confidence(catalogue, usage).withColumn("confidence", F.round("confidence", 6))


@query("V3_due_graphs", """
SELECT 'user-' || user_id AS graph_id, CAST(any_value(user_id) % 30 AS BIGINT) AS interval_minutes, max(ts) AS last_run_at
FROM events GROUP BY 1 HAVING any_value(user_id) % 30 >= 5 AND any_value(user_id) % 2 = 0
  AND epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts))) >= (any_value(user_id) % 30) * 60""")
def due_graphs(g):
    runs = g.table("events").groupBy("user_id").agg(F.max("ts").alias("last_run_at"))
    name = F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("graph_id")
    config = runs.select(name, (F.col("user_id") % 2 == 0).alias("enabled"), (F.col("user_id") % 30).alias("interval_minutes"), "last_run_at")
    plan = review.schedules(runs.select(name), config)
    return review.due_graphs(plan, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("graph_id", "interval_minutes", "last_run_at")
