"""Queries over texts, vectors, extraction payloads, ingest, maintenance and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from knotwork.functions import text
from knotwork.operators import extraction, facts as fact_ops, grading, ingest, maintenance, nearest, recall, resolution
from knotwork.operators.loop import cut
from knotwork.operators.ranking import top_k
from knotwork.plans.graph_queries import ROUNDS, TRADE, loop_sql, nodes_of, trade_facts
from knotwork.plans.registry import query
from knotwork.plans.stored_queries import COVERED, SUPPORT, covered
from knotwork.plans.tpch_graph import kg_sql, onto_sql
from knotwork.session import ensure_checkpoint_dir
from knotwork.sources import ontology as onto_source

TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
STRIPPED = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;|&amp;|&#\d+;', ' ', 'g'), '\s+', ' ', 'g'))"


@query("S11_strip_html", f"SELECT page_id, {STRIPPED} AS text FROM pages")
def strip_html(g):
    return g.table("pages").select("page_id", text.strip_html("html").alias("text"))


@query("S12_skip_to_narrative", f"""
WITH t AS (SELECT page_id, {STRIPPED} AS text FROM pages), f AS (SELECT *, strpos(lower(text), 'the') AS first FROM t),
s AS (SELECT *, CASE WHEN first > 0 THEN strpos(substr(lower(text), first + 1), 'the') ELSE 0 END AS gap FROM f)
SELECT page_id, CASE WHEN first = 0 THEN text WHEN gap > 0 THEN substr(text, first + gap) ELSE substr(text, first) END AS text FROM s""")
def skip_to_narrative(g):
    rows = g.table("pages").select("page_id", text.strip_html("html").alias("t"))
    return rows.select("page_id", text.skip_to_narrative("t", "the").alias("text"))


@query("X2_tokens", f"SELECT doc_id, CAST(len({TOKENS.format('text')}) AS BIGINT) AS n_tokens, list_aggregate(list_sort({TOKENS.format('text')}), 'string_agg', ' ') AS tokens FROM documents")
def token_sets(g):
    words = F.array_sort(text.tokens("text"))
    return g.table("documents").select("doc_id", F.size(words).cast("bigint").alias("n_tokens"), F.when(F.size(words) > 0, F.array_join(words, " ")).alias("tokens"))


def vocabulary(g):
    o = g.ontology
    return cut(o.classes.select("label").union(o.properties.select("label")).distinct())


RANKED = f"""
vocab AS (SELECT DISTINCT label FROM (SELECT label FROM class_rows UNION ALL SELECT label FROM property_rows)),
scored AS (SELECT doc_id, label, len(list_intersect({TOKENS.format('text')}, {TOKENS.format('label')})) AS overlap FROM documents, vocab),
ranked AS (SELECT doc_id, label, CAST(overlap AS BIGINT) AS overlap, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, label) AS BIGINT) AS rank FROM scored)"""


@query("X3_prompt_vocabulary", onto_sql(f"""
SELECT doc_id, kind, label, CAST(overlap AS BIGINT) AS overlap, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY overlap DESC, label) AS rank FROM (
    SELECT doc_id, kind, label, len(list_intersect(words, tokens)) AS overlap FROM (SELECT doc_id, {TOKENS.format('text')} AS words FROM documents), (
      SELECT kind, label, {TOKENS.format('label')} AS tokens FROM (SELECT DISTINCT 'class' AS kind, label FROM class_rows UNION SELECT 'property', label FROM property_rows))))
WHERE rank <= CASE kind WHEN 'class' THEN 60 ELSE 40 END"""))
def prompt_vocabulary(g):
    o = g.ontology
    return extraction.prompt_vocabulary(g.table("documents"), cut(o.classes.select("label").distinct()), cut(o.properties.select("label").distinct()))


@query("T4_vocabulary_top", onto_sql("SELECT label, count(*) AS documents FROM ranked WHERE rank <= 2 GROUP BY 1", RANKED))
def vocabulary_top(g):
    return extraction.vocabulary_ranking(g.table("documents"), vocabulary(g), 2).groupBy("label").agg(F.count("*").alias("documents"))


def dictionary(g):
    """Names found in the benchmark texts: all their words, and the first two words of each item."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)
    items = g.table("benchmark").select(words.alias("w"))
    single = items.select(F.explode("w").alias("name"), F.lit("term").alias("type"))
    heads = items.filter(F.size("w") > 1).select(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("name"), F.lit("opening").alias("type"))
    return single.union(heads).distinct()


@query("X4_dictionary_extraction", r"""
WITH b AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
names AS (SELECT DISTINCT unnest(w) AS name, 'term' AS type FROM b UNION SELECT w[1] || ' ' || w[2], 'opening' FROM b WHERE len(w) > 1),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
grams AS (SELECT doc_id, unnest(w) AS name FROM d UNION SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d)
SELECT DISTINCT doc_id, name, type FROM grams JOIN names USING (name)""")
def dictionary_extraction(g):
    payloads = extraction.extract_by_dictionary(g.table("documents"), dictionary(g))
    found = payloads.select("doc_id", F.explode(F.from_json("payload", extraction.EXTRACTION)["entities"]).alias("e"))
    return found.select("doc_id", F.col("e.name").alias("name"), F.col("e.type").alias("type"))


# Extraction payloads made of the orders; those of pending orders are cut off and do not parse.

def order_documents(g):
    sold = (
        g.table("lineitem").select("l_orderkey", "l_suppkey").distinct()
        .join(g.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
        .groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s_name")).alias("sellers"))
    )
    rows = (
        g.table("orders").join(g.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), "o_custkey")
        .join(sold, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .withColumn("sellers", F.coalesce("sellers", F.array().cast("array<string>")))
    )
    total = F.concat(F.lit("total "), F.col("o_orderkey").cast("string"))

    def entity(name, kind, confidence=None):
        return F.struct(name.alias("name"), kind.alias("type"), F.lit(confidence).cast("double").alias("confidence"))

    def link(source, relation, target, confidence=None):
        return F.struct(source.alias("source"), F.lit(relation).alias("relation"), target.alias("target"), F.lit(confidence).cast("double").alias("confidence"))

    name = F.col("c_name")
    entities = F.concat(
        F.array(entity(name, F.concat("c_mktsegment", F.lit(" Customer")), 0.9)),
        F.transform("sellers", lambda s: entity(s, F.lit("supplier"))),
        F.array(entity(total, F.lit("size band"), 0.8), entity(F.col("o_orderpriority"), F.lit("priority")), entity(F.lit(" "), F.lit("supplier"))),
    )
    links = F.concat(
        F.array(link(F.upper("c_name"), "is priced at", total, 0.7)),
        F.transform("sellers", lambda s: link(name, "purchases from", F.lower(s), 0.6)),
        F.array(link(name, "admires", total), link(name, "supplies", F.lit("Nobody"))),
        F.when(F.col("o_orderstatus") == "F", F.array(link(name, "is located in", total))).otherwise(F.expr("array()").cast("array<struct<source:string,relation:string,target:string,confidence:double>>")),
    )
    payload = F.to_json(F.struct(entities.alias("entities"), links.alias("relationships")))
    return rows.withColumn("payload", payload).select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("o_orderstatus") == "P", F.expr("left(payload, length(payload) div 2)")).otherwise(F.col("payload")).alias("payload"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("text"), F.lit("orders").alias("source_doc"), F.col("o_orderdate").alias("at"),
    )


EXTRACTED = """
good AS (SELECT o.*, c_name, c_mktsegment FROM orders o JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'),
sold AS (SELECT l_orderkey, s_name, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY s_name) AS BIGINT) AS n
         FROM (SELECT DISTINCT l_orderkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)),
ent AS (SELECT o_orderkey AS doc_id, c_name AS name, c_mktsegment || ' Customer' AS type, CAST(0.9 AS DOUBLE) AS confidence FROM good
        UNION ALL SELECT o_orderkey, s_name, 'supplier', 1.0 FROM good JOIN sold ON l_orderkey = o_orderkey
        UNION ALL SELECT o_orderkey, 'total ' || o_orderkey, 'size band', 0.8 FROM good),
rel AS (SELECT o_orderkey AS doc_id, c_name AS source, 'is priced at' AS relation, 'total ' || o_orderkey AS target, CAST(0.7 AS DOUBLE) AS confidence FROM good
        UNION ALL SELECT o_orderkey, c_name, 'purchases from', s_name, 0.6 FROM good JOIN sold ON l_orderkey = o_orderkey
        UNION ALL SELECT o_orderkey, c_name, 'is located in', 'total ' || o_orderkey, 1.0 FROM good WHERE o_orderstatus = 'F')"""


@query("X1_validated_entities", f"WITH {EXTRACTED} SELECT * FROM ent")
def validated_entities(g):
    return extraction.validate(order_documents(g), g.ontology)[0].select("doc_id", "name", "type", "confidence")


@query("X1_validated_relationships", f"WITH {EXTRACTED} SELECT * FROM rel")
def validated_relationships(g):
    return extraction.validate(order_documents(g), g.ontology)[1].select("doc_id", "source", "relation", "target", "confidence")


@query("X1_rejects", """
SELECT split_part(reason, ' ', 1) AS reason, count(*) AS n FROM (
  SELECT unnest(CASE WHEN o_orderstatus = 'P' THEN ['Could not parse'] ELSE ['Entity ''x has', 'Entity missing', 'Relationship', 'Relationship'] END) AS reason FROM orders)
GROUP BY 1""")
def rejects(g):
    return extraction.validate(order_documents(g), g.ontology)[2].groupBy(F.split_part("reason", F.lit(" "), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))


@query("X5_materialization", f"""
WITH {EXTRACTED} SELECT e.doc_id, e.name, CASE WHEN e.type = 'size band' AND o_orderstatus <> 'F' THEN 'property' ELSE 'node' END AS policy,
  CASE WHEN e.type = 'size band' AND o_orderstatus <> 'F' THEN c_name END AS attach_to,
  CASE WHEN e.type = 'size band' THEN CASE WHEN o_orderstatus <> 'F' THEN 'role=value, fanout=1, inlined via ''is priced at''' ELSE 'role=value, fanout=2' END ELSE 'no role resolved' END AS reason
FROM ent e JOIN good ON o_orderkey = doc_id""")
def materialization(g):
    from knotwork.operators.ontology import label_closure, type_roles

    entities, relationships, _ = extraction.validate(order_documents(g), g.ontology)
    roles = type_roles(entities.select("type"), label_closure(g.ontology))
    return extraction.plan_materialization(entities, relationships, roles).select("doc_id", "name", "policy", "attach_to", "reason")


SLUGS = "'g:' || trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
INGESTED = f"""
acts AS (
  SELECT {SLUGS.format('c_name')} AS source, 'purchases from' AS type, {SLUGS.format('s_name')} AS target, CAST(0.6 AS DOUBLE) AS weight, o_orderdate AS moment,
         o_orderkey AS doc, n AS pos FROM good JOIN sold ON l_orderkey = o_orderkey
  UNION ALL SELECT {SLUGS.format('c_name')}, 'is located in', {SLUGS.format("'total ' || o_orderkey")}, 1.0, o_orderdate, o_orderkey, 10000 FROM good WHERE o_orderstatus = 'F'
  UNION ALL SELECT {SLUGS.format('c_name')}, 'is priced at', {SLUGS.format("'total ' || o_orderkey")}, 0.7, o_orderdate, o_orderkey, 0 FROM good WHERE o_orderstatus = 'F'),
seqd AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source, type ORDER BY moment, doc, pos) AS seq FROM acts),
firsts AS MATERIALIZED (SELECT source, type, target, min(seq) AS seq, min(moment) AS valid_at FROM seqd GROUP BY 1, 2, 3),
closed AS (SELECT f.source, f.type, f.target, arg_min(x.moment, x.seq) AS invalid_at FROM firsts f JOIN seqd x ON x.source = f.source AND x.type = f.type AND x.target <> f.target AND x.seq > f.seq GROUP BY 1, 2, 3)"""
INGESTED_EDGES = f"""
WITH {EXTRACTED}, {INGESTED} SELECT f.source || '->' || replace(f.type, ' ', '-') || '->' || substr(f.target, 3) AS id, f.valid_at, c.invalid_at
FROM firsts f LEFT JOIN closed c ON c.source = f.source AND c.type = f.type AND c.target = f.target"""


@query("X6_ingest_edges", INGESTED_EDGES)
def ingest_edges(g):
    return ingest.ingest(order_documents(g), g.ontology, "g")[1].select("id", "valid_at", "invalid_at")


@query("X6_ingest_nodes", f"""
WITH {EXTRACTED}, last AS (SELECT c_name, arg_max('total ' || o_orderkey, (o_orderdate, o_orderkey)) AS total FROM good WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT {SLUGS.format('name')} AS id, any_value(type) AS type, coalesce(any_value(total), '') AS priced_at FROM ent JOIN good ON doc_id = o_orderkey LEFT JOIN last ON last.c_name = ent.name
WHERE type <> 'size band' OR o_orderstatus = 'F' GROUP BY 1""")
def ingest_nodes(g):
    nodes = ingest.ingest(order_documents(g), g.ontology, "g")[0]
    return nodes.select("id", "type", F.coalesce(F.col("properties")["is priced at"], F.lit("")).alias("priced_at"))


@query("X6_ingest_events", f"""
WITH {EXTRACTED}, e AS (SELECT doc_id, count(*) AS n FROM ent GROUP BY 1), r AS (SELECT doc_id, count(*) AS n FROM rel GROUP BY 1)
SELECT 'g:evt-' || o_orderkey AS id, coalesce(e.n, 0) AS entity_count, coalesce(r.n, 0) AS relationship_count, CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 4 END AS BIGINT) AS dropped_count
FROM orders LEFT JOIN e ON e.doc_id = o_orderkey LEFT JOIN r ON r.doc_id = o_orderkey""")
def ingest_events(g):
    return ingest.ingest_log(order_documents(g), g.ontology, "g").events.select("id", "entity_count", "relationship_count", "dropped_count")


@query("Y1_streamed_edges", INGESTED_EDGES)
def streamed_edges(g):
    from knotwork.streaming import jobs

    base = f"{ensure_checkpoint_dir(g.spark)}/stream-{uuid.uuid4().hex}"
    order_documents(g).repartitionByRange(3, "at").write.parquet(f"{base}/in")
    jobs.stream_ingest(g.spark, f"{base}/in", f"{base}/log", f"{base}/state", g.ontology, "g", files_per_batch=2)
    return jobs.stored_edges(g.spark, f"{base}/log").select("id", "valid_at", "invalid_at")


@query("X7_context_blocks", """
SELECT CAST(conv_id AS VARCHAR) AS entity_id, CAST((r - 1) // 3 AS BIGINT) AS block, string_agg(text, ' ' ORDER BY r) AS context FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations) GROUP BY 1, 2""")
def context_blocks(g):
    return extraction.context_blocks(turns(g), 3)


def turns(g):
    return g.table("conversations").select(F.col("conv_id").cast("string").alias("entity_id"), F.col("turn").alias("ord"), "text")


def heads(old: str, context: str) -> str:
    """A summary that keeps the first words of each block of contexts."""
    head = context.replace("\n", " ")[:40].strip(" ")
    return f"{old} / {head}" if old else head


@query("X7_latest_summaries", """
SELECT entity_id, trim(string_agg(trim(left(context, 40), ' '), ' / ' ORDER BY block), ' ') AS summary FROM (
  SELECT CAST(conv_id AS VARCHAR) AS entity_id, (r - 1) // 3 AS block, replace(string_agg(text, ' ' ORDER BY r), chr(10), ' ') AS context FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations) GROUP BY 1, 2) GROUP BY 1""")
def latest_summaries(g):
    none = g.spark.createDataFrame([], "entity_id string, summary string")
    return extraction.summarise_with(turns(g), none, heads, 3)


def heuristic_payloads(g):
    anchors = F.array(g.node("customer", "o_custkey"), F.lit("tpch:ghost"))
    fact = lambda t, a, c: F.struct(t.alias("text"), a.alias("anchors"), F.lit(c).cast("double").alias("confidence"))
    facts = F.array(
        fact(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), anchors, 0.7), fact(F.concat(F.lit("again "), F.col("o_orderkey").cast("string")), anchors, None),
        fact(F.lit(" "), anchors, 0.7), fact(F.lit("lost"), F.array(F.lit("tpch:ghost")), 0.7),
    )
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "nonsense").when(F.col("o_orderpriority") == "1-URGENT", "causal_relation").otherwise("event_sequence")
    payload = F.to_json(F.struct(facts.alias("facts")))
    return g.table("orders").select(
        F.lit("tpch").alias("graph_id"), kind.alias("heuristic_type"), F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit("{broken")).otherwise(payload).alias("payload"),
    )


HEURISTIC_SQL = """
SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'causal_relation' ELSE 'event_sequence' END AS heuristic_type, o_orderkey AS doc_id, t || o_orderkey AS text, c AS confidence,
       'tpch:customer-' || o_custkey AS anchors
FROM orders, (VALUES ('order ', CAST(0.7 AS DOUBLE)), ('again ', 0.5)) v(t, c) WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P'"""


@query("X8_implicit_facts", HEURISTIC_SQL)
def implicit_facts(g):
    facts, _ = extraction.validate_heuristics(heuristic_payloads(g), g.entities)
    return facts.select("heuristic_type", "doc_id", "text", "confidence", F.array_join("anchor_entity_ids", ",").alias("anchors"))


@query("X8_rejects", """
SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN o_orderpriority = '5-LOW' THEN ['Unknown heuristic type ''nonsense'''] WHEN o_orderstatus = 'P' THEN ['Could not parse response as JSON']
  ELSE ['Fact missing text', 'Fact has no anchors in this graph'] END) AS reason FROM orders) GROUP BY 1""")
def implicit_rejects(g):
    return extraction.validate_heuristics(heuristic_payloads(g), g.entities)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("X9_ungrounded_claims", r"""
WITH pairs AS (SELECT a.doc_id, a.text AS reply, lower(b.text) AS g FROM documents a JOIN documents b ON b.doc_id = a.doc_id - 1),
lists AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(reply, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS parts FROM pairs),
s AS (SELECT doc_id, g, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS pos FROM lists),
a AS (SELECT *, regexp_replace(lower(sentence[1]) || sentence[2:], '[^\x00-\x7F]', '_', 'g') AS adjusted FROM s),
t AS (SELECT *, list_concat(regexp_extract_all(adjusted, '\b[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)+\b'), regexp_extract_all(adjusted, '\b\d[\d,.]{2,}\b')) AS found FROM a)
SELECT 'doc-' || doc_id AS id, CAST(pos AS BIGINT) AS pos, sentence FROM t WHERE len(list_filter(found, lambda x: NOT contains(g, lower(x)))) > 0""")
def ungrounded_claims(g):
    """Each document is checked against the one before it."""
    rows = g.table("documents").select("doc_id", "text")
    before = rows.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("grounding"))
    replies = rows.join(before, "doc_id").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("reply"), "grounding"
    )
    return extraction.ungrounded_claims(replies)


# Vectors and resolution.

NEAR = """
unit AS MATERIALIZED (SELECT 'v' || vec_id AS id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
scores AS (SELECT a.id, b.id AS other_id, round(sqrt(greatest(0, list_distance(a.v, b.v) ** 2)), 9) AS d FROM unit a JOIN unit b ON a.id <> b.id),
near AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY d, other_id) AS BIGINT) AS rank, (1 + (1 - d * d / 2)) / 2 AS score FROM scores WHERE d <= sqrt(2.0) + 1e-9 QUALIFY rank <= 10)"""


@query("E1_similar_entities", f"WITH {NEAR} SELECT id, other_id, rank, round(score, 6) AS score FROM near")
def similar_entities(g):
    return resolution.similar_entities(g.vectors).select("id", "other_id", "rank", F.round("score", 6).alias("score"))


LABELS = ["Alpha Works Inc", "Alpha Works Corp", "Beta AG", "Beta Group", "Gamma Steel", "Gamma Steel Ltd", "Delta Co", "Delta Foods", "Omega", "Omega LLC"]


def labelled_vectors(g):
    names = F.array(*[F.lit(x) for x in LABELS])
    return g.table("embeddings").select(
        F.lit("tpch").alias("graph_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), F.element_at(names, F.col("label") + 1).alias("label"),
        F.concat(F.lit("kind "), F.col("label").cast("string")).alias("type"), F.col("embedding").cast("array<double>").alias("vector"), (F.col("label") == 9).alias("derived"),
    )


def kind_closure(g):
    """Every even kind is a subclass of the odd kind after it."""
    kinds = g.table("embeddings").select("label").distinct()
    name = F.concat(F.lit("kind "), F.col("label").cast("string"))
    same = kinds.select(name.alias("child"), name.alias("parent"))
    up = kinds.filter(F.col("label") % 2 == 0).select(name.alias("child"), F.concat(F.lit("kind "), (F.col("label") + 1).cast("string")).alias("parent"))
    return same.union(up)


CORE = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda x: x NOT IN ('corp', 'corporation', 'inc', 'incorporated', 'ag', 'ltd', 'limited', 'group', 'plc', 'llc', 'gmbh', 'sa', 'nv', 'co', 'company'))"
DUPLICATES = f"""
names AS (SELECT 'v' || vec_id AS id, label, [{', '.join("'" + x + "'" for x in LABELS)}][label + 1] AS name FROM embeddings),
dup AS (SELECT n.id, n.other_id, n.score, n.rank, {CORE.format('a.name')} AS x, {CORE.format('b.name')} AS y
  FROM near n JOIN names a ON a.id = n.id JOIN names b ON b.id = n.other_id WHERE a.label // 2 = b.label // 2),
dups AS (SELECT 'dup-tpch-' || id || '-' || other_id AS candidate_id, id AS new_entity_id, other_id AS existing_entity_id, round(score, 6) AS similarity FROM dup
  WHERE len(x) > 0 AND len(y) > 0 AND len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.6 QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank) = 1)"""


@query("E3_duplicate_candidates", f"WITH {NEAR}, {DUPLICATES} SELECT * FROM dups")
def duplicate_candidates(g):
    rows = resolution.duplicate_candidates(labelled_vectors(g).drop("derived"), kind_closure(g))
    return rows.select("candidate_id", "new_entity_id", "existing_entity_id", F.round("similarity", 6).alias("similarity"))


@query("E4_duplicate_recheck", f"WITH {NEAR}, {DUPLICATES} SELECT d.* FROM dups d JOIN names n ON n.id = d.new_entity_id WHERE n.label <> 9")
def duplicate_recheck(g):
    rows = resolution.duplicate_candidates(labelled_vectors(g), kind_closure(g))
    return rows.select("candidate_id", "new_entity_id", "existing_entity_id", F.round("similarity", 6).alias("similarity"))


@query("E2_label_match", f"""
WITH p AS (SELECT a.p_partkey AS key, {CORE.format("a.p_name || ' Inc'")} AS x, {CORE.format("b.p_name || ' AG'")} AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT key, len(x) > 0 AND len(y) > 0 AND len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.6 AS same FROM p""")
def label_match(g):
    part = g.table("part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat("p_name", F.lit(" AG")).alias("b"))
    return part.join(other, "p_partkey").select(F.col("p_partkey").alias("key"), text.labels_plausibly_same(F.concat("p_name", F.lit(" Inc")), F.col("b")).alias("same"))


def centroids(g):
    """One query vector per label: the mean of its vectors."""
    means = g.table("embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector")).select(
        F.lit("tpch").alias("graph_id"), F.concat(F.lit("q"), F.col("label").cast("string")).alias("id"), "vector"
    )


CENTROIDS = """
means AS (SELECT label, pos, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2),
queries AS (SELECT label, list(x ORDER BY pos) AS q FROM means GROUP BY 1),
hits AS MATERIALIZED (SELECT 'q' || q.label AS query_id, 'v' || vec_id AS id, e.label, list_cosine_similarity(q, embedding::DOUBLE[]) AS c FROM queries q, embeddings e),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sqrt(greatest(0, 2 - 2 * c)), 9), id) AS BIGINT) AS rank FROM hits)"""


@query("K2_vector_recall", f"WITH {CENTROIDS} SELECT query_id, id, rank, round((1 + c) / 2, 6) AS score FROM best WHERE rank <= 10")
def vector_recall(g):
    return recall.vector_recall(centroids(g), g.vectors).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("W5_top_per_query", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS BIGINT) AS rank FROM events QUALIFY rank <= 3")
def top_per_query(g):
    return top_k(g.table("events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.asc("event_id")], 3).drop("value")


def summaries(g):
    return g.table("documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("summary"))


def words_sql(term: str, limit: int = 10) -> str:
    return f"""
words AS (
  SELECT 'chat_message' AS kind, 'm-' || conv_id || '-' || turn AS id, 1 AS source, row_number() OVER (ORDER BY turn DESC, 'm-' || conv_id || '-' || turn) AS pos
  FROM conversations WHERE contains(lower(text), lower('{term}')) QUALIFY pos <= {limit}
  UNION ALL SELECT 'entity_summary', 'doc-' || doc_id, 2, row_number() OVER (ORDER BY 'doc-' || doc_id) AS pos
  FROM documents WHERE contains(lower(text), lower('{term}')) QUALIFY pos <= {limit})"""


@query("K1_keyword_recall", f"WITH {words_sql('Tion')} SELECT kind, id, CAST(pos AS BIGINT) AS pos FROM words")
def keyword_recall(g):
    return recall.keyword_recall(g.messages, summaries(g), "Tion").select("kind", "id", "pos")


def hybrid(g, limit=25):
    hits = cut(recall.vector_recall(centroids(g).filter("id = 'q3'"), g.vectors.join(g.table("embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), F.col("label").alias("n")), "id"), 8))
    entity = hits.select("id", F.col("rank").alias("pos"))
    message = hits.select(F.when(F.col("rank") % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("m"), "id")).alias("id"), F.col("rank").alias("pos"))
    return recall.hybrid_recall(g.messages, summaries(g), "tion", entity, message, limit)


HYBRID = f"""
{words_sql('tion', 25)}, {CENTROIDS}, v AS (SELECT id, rank FROM best WHERE query_id = 'q3' AND rank <= 8),
every AS (SELECT id, kind, 0 AS part, source * 25 + pos AS pos FROM words UNION ALL SELECT id, 'entity_summary', 1, rank FROM v
          UNION ALL SELECT CASE WHEN rank % 2 = 0 THEN id ELSE 'm' || id END, 'chat_message', 2, rank FROM v),
firsts AS (SELECT id, arg_min(kind, (part, pos)) AS kind, min((part, pos)) AS k FROM every GROUP BY 1)"""


@query("K3_hybrid_recall", f"WITH {HYBRID} SELECT id, kind, CAST(row_number() OVER (ORDER BY k, id) AS BIGINT) AS rank FROM firsts QUALIFY rank <= 25")
def hybrid_recall(g):
    return hybrid(g).select("id", "kind", "rank")


@query("K3_hybrid_by_query", f"""
WITH {words_sql('tion', 25)}, {CENTROIDS}, v AS (SELECT query_id, id, rank FROM best WHERE rank <= 8),
every AS (SELECT query_id, id, kind, 0 AS part, source * 25 + pos AS pos FROM words, (SELECT DISTINCT query_id FROM v) UNION ALL SELECT query_id, id, 'entity_summary', 1, rank FROM v
          UNION ALL SELECT query_id, CASE WHEN rank % 2 = 0 THEN id ELSE 'm' || id END, 'chat_message', 2, rank FROM v),
firsts AS (SELECT query_id, id, arg_min(kind, (part, pos)) AS kind, min((part, pos)) AS k FROM every GROUP BY 1, 2)
SELECT query_id, id, kind, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k, id) AS BIGINT) AS rank FROM firsts QUALIFY rank <= 25""")
def hybrid_by_query(g):
    asked = cut(centroids(g))
    hits = cut(recall.vector_recall(asked, g.vectors, 8))
    entity = hits.select("query_id", "id", F.col("rank").alias("pos"))
    message = hits.select("query_id", F.when(F.col("rank") % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("m"), "id")).alias("id"), F.col("rank").alias("pos"))
    found = recall.hybrid_by_query(g.messages, summaries(g), "tion", asked.select(F.col("id").alias("query_id")), entity, message, 25)
    return found.select("query_id", "id", "kind", "rank")


@query("U3_merged_hits", """
WITH e AS (SELECT 'u' || user_id AS id, event_type AS kind, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS part, event_id AS pos FROM events),
f AS (SELECT id, arg_min(kind, (part, pos)) AS kind, min((part, pos)) AS k FROM e GROUP BY 1)
SELECT id, kind, CAST(row_number() OVER (ORDER BY k, id) AS BIGINT) AS rank FROM f QUALIFY rank <= 120""")
def merged_hits(g):
    rows = g.table("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("kind"), F.col("event_id").alias("pos"))
    parts = [rows.filter(F.col("kind") == "click"), rows.filter(F.col("kind") == "purchase"), rows.filter(~F.col("kind").isin("click", "purchase"))]
    return recall.merge_hits(parts, 120).select("id", "kind", "rank")


QUESTION = "What did I ask about the Reaux, entre or zzzzz before?"


@query("K4_question_recall", f"""
WITH w1 AS (WITH {words_sql('Reaux')} SELECT *, 0 AS term FROM words), w2 AS (WITH {words_sql('entre')} SELECT *, 1 AS term FROM words),
w3 AS (WITH {words_sql('zzzzz')} SELECT *, 2 AS term FROM words),
w AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY source, pos) AS place FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3) QUALIFY place <= 10),
f AS (SELECT id, arg_min(kind, (term, place)) AS kind, min((term, place)) AS k FROM w GROUP BY 1)
SELECT id, kind, CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS rank, round((SELECT count(DISTINCT term) FROM w) / 3, 6) AS confidence FROM f QUALIFY rank <= 10""")
def question_recall(g):
    return recall.question_recall(g.messages, summaries(g), QUESTION).select("id", "kind", "rank", F.round("confidence", 6).alias("confidence"))


TASK = "the ention and thanthe Reaux of entre with tion"


def catalogue(g):
    marks = g.table("labels").select("doc_id", F.when(F.col("quality") == 1, 0.9).otherwise(0.4).alias("confidence"))
    return g.table("documents").join(marks, "doc_id", "left").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("description"), "confidence", F.col("lang").alias("domain")
    )


@query("K5_overlap_ranking", r"""
WITH t AS (SELECT list_filter(list_distinct(string_split(lower('the ention and thanthe Reaux of entre with tion'), ' ')), lambda x: length(x) > 2) AS task),
s AS (SELECT 'doc-' || doc_id AS name, len(list_intersect((SELECT task FROM t), list_transform(string_split_regex(trim(lower(text)), '\s+'), lambda x: trim(x, '.,()')))) AS n FROM documents)
SELECT name, round(n / (SELECT len(task) FROM t), 6) AS score, CAST(row_number() OVER (ORDER BY n DESC, name) AS BIGINT) AS rank FROM s WHERE n > 0 QUALIFY rank <= 50""")
def overlap_ranking(g):
    return recall.overlap_ranking(catalogue(g), TASK, 50).withColumn("score", F.round("score", 6))


BM25 = r"""
WITH d AS (SELECT 'doc-' || d.doc_id AS name, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL OR l.quality = 1),
q AS (SELECT DISTINCT unnest(regexp_extract_all(lower('the ention and thanthe Reaux of entre with tion'), '[a-z0-9]+')) AS term),
tf AS (SELECT name, term, count(*) AS tf FROM (SELECT name, unnest(w) AS term FROM d) JOIN q USING (term) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
s AS (SELECT d.name, any_value(lang) AS lang, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))) AS score FROM tf JOIN df USING (term) JOIN d ON d.name = tf.name, c GROUP BY 1),
b AS (SELECT name, score + CASE WHEN lang = 'fr' THEN 0.2 ELSE 0 END AS score FROM s)
SELECT name, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, name) AS BIGINT) AS rank FROM b QUALIFY rank <= 30"""


@query("K6_ranked_search", BM25)
def ranked_search(g):
    hits = recall.ranked_search(catalogue(g), TASK, "fr", 30)
    return hits.withColumn("score", F.round("score", 6))


@query("K6_prerequisites", f"""
WITH hits AS ({BM25}), r AS (SELECT DISTINCT 'doc-' || a.doc_id AS name, 'doc-' || b.doc_id AS required FROM documents a JOIN documents b ON b.doc_id = a.doc_id // 2)
SELECT name, coalesce(string_agg(required, ',' ORDER BY required), '') AS requires FROM hits LEFT JOIN r USING (name) GROUP BY 1""")
def prerequisites(g):
    docs = g.table("documents").select("doc_id")
    requires = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.concat(F.lit("doc-"), F.floor(F.col("doc_id") / 2).cast("string")).alias("required"))
    hits = recall.ranked_search(catalogue(g), TASK, "fr", 30)
    return recall.with_prerequisites(hits, requires).select("name", F.array_join("requires", ",").alias("requires"))


# Node typing by features.

def features(g):
    n = g.node
    f = lambda *kv: F.create_map(*[x for k, v in kv for x in (F.lit(k), v.cast("double"))]).alias("features")
    frames = [
        g.table("customer").select(n("customer", "c_custkey").alias("node_id"), f(("balance", F.col("c_acctbal")), ("nation", F.col("c_nationkey")))),
        g.table("supplier").select(n("supplier", "s_suppkey").alias("node_id"), f(("balance", F.col("s_acctbal")), ("nation", F.col("s_nationkey")))),
        g.table("nation").select(n("nation", "n_nationkey").alias("node_id"), f(("nation", F.col("n_nationkey")))),
        g.table("part").select(n("part", "p_partkey").alias("node_id"), f(("size", F.col("p_size")))),
    ]
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


@query("G18_feature_typing", kg_sql("""
SELECT n.id, CASE WHEN n.source_doc = 'customer' THEN c_mktsegment WHEN h.d IS NULL THEN 'unknown' ELSE h.label END AS predicted_type,
       CASE WHEN n.source_doc = 'customer' THEN 1.0 WHEN h.d IS NULL THEN 0.0 ELSE round(1 / (1 + h.d), 6) END AS confidence
FROM entities n LEFT JOIN customer c ON n.id = 'tpch:customer-' || c_custkey LEFT JOIN h ON h.id = n.id""", """
pairs AS (SELECT 'tpch:supplier-' || s_suppkey AS id, 'tpch:customer-' || c_custkey AS other, c_mktsegment AS label, round(sqrt((s_acctbal - c_acctbal) ** 2 + (s_nationkey - c_nationkey) ** 2), 9) AS d FROM supplier, customer
  UNION ALL SELECT 'tpch:nation-' || n_nationkey, 'tpch:customer-' || c_custkey, c_mktsegment, abs(n_nationkey - c_nationkey)::DOUBLE FROM nation, customer),
h AS (SELECT id, arg_min(label, (d, other)) AS label, min(d) AS d FROM pairs GROUP BY 1)"""))
def feature_typing(g):
    labels = g.table("customer").select(g.node("customer", "c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    return nearest.by_features(g.entities, features(g), labels).withColumn("confidence", F.round("confidence", 6))


@query("J12_dependent_facts", "WITH " + TRADE + " SELECT a.id, count(*) AS dependents FROM trade a JOIN trade b ON b.s = a.t GROUP BY 1")
def dependent_facts(g):
    facts = trade_facts(g)
    by_source = facts.groupBy(F.col("source_id").alias("target_id")).agg(F.count("*").alias("dependents"))
    return facts.join(by_source, "target_id").select("id", "dependents")


# Evaluation and maintenance.

def outputs(g):
    rows = g.table("conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.col("text")))).alias("items"), F.count("*").alias("n"),
        F.array_sort(F.collect_set(F.struct(F.col("role").alias("name"), F.concat(F.lit("role "), "role").alias("type")))).alias("entities"),
    )
    return rows.select(
        F.col("conv_id").alias("case_id"), "entities", F.slice("entities", 1, 1).alias("relationships"), "items",
        F.when(F.col("n") > 6, "too long").alias("error"), F.col("n").alias("iterations"), F.when(F.col("n") % 2 == 0, "fixpoint").alias("converged_by"), (F.col("n") > 4).alias("found"),
    )


KINDS = "entity_count relationship_count min_entity_count min_relationship_count item_count min_item_count entity_type_match relationship_type_match no_error min_iterations converged path_found contains_text mystery".split()


def assertions(g):
    return g.table("conversations").select("conv_id").distinct().select(F.col("conv_id").alias("case_id"), F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("type")).withColumns({
        "assertion_id": F.concat_ws("-", F.col("case_id").cast("string"), "type"), "value": F.when(F.col("type") == "min_iterations", 5).otherwise(2), "text": F.lit("TION"),
        "subject": F.lit("user"), "expected_type": F.when(F.col("type") == "entity_type_match", "role user").otherwise("role nobody"),
    })


@query("V4_grades", f"""
WITH o AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS e, count(*) FILTER (role = 'assistant') AS i, bool_or(role = 'user') AS u, min(role) AS r,
                  bool_or(role = 'assistant' AND contains(lower(text), 'tion')) AS t FROM conversations GROUP BY 1),
k AS (SELECT unnest([{', '.join("'" + k + "'" for k in KINDS)}]) AS type)
SELECT conv_id AS case_id, type, coalesce(CASE type WHEN 'entity_count' THEN e = 2 WHEN 'relationship_count' THEN false WHEN 'min_entity_count' THEN e >= 2 WHEN 'min_relationship_count' THEN false
  WHEN 'item_count' THEN i = 2 WHEN 'min_item_count' THEN i >= 2 WHEN 'entity_type_match' THEN u WHEN 'relationship_type_match' THEN false WHEN 'no_error' THEN n <= 6
  WHEN 'min_iterations' THEN n >= 5 WHEN 'converged' THEN n % 2 = 0 WHEN 'path_found' THEN n > 4 WHEN 'contains_text' THEN t END, false) AS passed FROM o, k""")
def grades(g):
    return grading.grade(assertions(g), outputs(g)).select("case_id", "type", "passed")


def maintenance_run(g):
    return maintenance.run_maintenance("tpch", nodes_of(g), g.edges, g.rules, g.ontology, covered(g), labelled_vectors(g))


MAINTAINED = loop_sql(ROUNDS, f"""
SELECT 'tpch' AS graph_id, (SELECT count(*) FROM confidence WHERE support >= 3 AND confidence >= 0.6 AND (edge_type, source_type, target_type) NOT IN (SELECT (edge_type, source_type, target_type) FROM covered)) AS mined_candidates,
  (SELECT count(*) FROM dups JOIN names ON names.id = new_entity_id WHERE names.label <> 9 AND names.label IN (SELECT a.label FROM names a)) AS duplicate_candidates,
  (SELECT count(*) FROM facts{ROUNDS}) AS new_facts,
  (SELECT string_agg(id || '=' || weight, ',' ORDER BY id) FROM rules WHERE id IN (SELECT rule_id FROM facts{ROUNDS})) AS weights""").replace(
    "\nSELECT 'tpch' AS graph_id", f",\n{SUPPORT.strip()},\n{COVERED},\n{NEAR.strip()},\n{DUPLICATES.strip().replace('a.label // 2 = b.label // 2', 'a.label = b.label')}\nSELECT 'tpch' AS graph_id", 1)


@query("A13_maintenance_summary", MAINTAINED)
def maintenance_summary(g):
    row = maintenance_run(g)[3]
    weights = F.array_join(F.transform(F.map_entries("active_rule_weights"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return row.select("graph_id", "mined_candidates", "duplicate_candidates", "new_facts", weights.alias("weights"))


@query("V2_maintenance_pass", MAINTAINED.replace("SELECT 'tpch' AS graph_id, (", f"SELECT 'tpch' AS graph_id, true AS reasoning_ran, CAST({ROUNDS} AS BIGINT) AS iterations, 'fixpoint' AS converged_by, ("))
def maintenance_pass(g):
    return ran(maintenance_run(g)[3])


def ran(rows):
    weights = F.array_join(F.transform(F.map_entries("active_rule_weights"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return rows.select("graph_id", "reasoning_ran", "iterations", "converged_by", "mined_candidates", "duplicate_candidates", "new_facts", weights.alias("weights"))


@query("Y2_streamed_maintenance", MAINTAINED.replace("SELECT 'tpch' AS graph_id, (", f"SELECT 'tpch' AS graph_id, true AS reasoning_ran, CAST({ROUNDS} AS BIGINT) AS iterations, 'fixpoint' AS converged_by, ("))
def streamed_maintenance(g):
    """The runs of the graphs whose schedule is due: of the stored graph, not of users whose schedule is off or not due."""
    from knotwork.operators.review import schedules
    from knotwork.streaming import jobs

    base = f"{ensure_checkpoint_dir(g.spark)}/schedule-{uuid.uuid4().hex}"
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    users = g.table("events").select("user_id").distinct().select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("graph_id"), (F.col("user_id") % 2 == 0).alias("enabled"),
        F.lit(60).cast("bigint").alias("interval_minutes"), F.when(F.col("user_id") % 2 == 0, now).alias("last_run_at"),
    )
    own = g.spark.range(1).select(F.lit("tpch").alias("graph_id"), F.lit(True).alias("enabled"), F.lit(30).cast("bigint").alias("interval_minutes"), F.lit(None).cast("timestamp").alias("last_run_at"))
    config = own.unionByName(users)
    schedules(config.select("graph_id"), config).repartition(2).write.parquet(f"{base}/in")

    def graph(name):
        return nodes_of(g), g.edges, g.rules, g.ontology, covered(g), labelled_vectors(g)

    def run(due, number):
        maintenance.maintain_due(due, graph, f"{base}/runs", number)

    schema = "graph_id string, enabled boolean, interval_minutes bigint, last_run_at timestamp"
    jobs.stream_maintenance(g.spark, f"{base}/in", schema, f"{base}/state", now, run)
    return ran(g.spark.read.option("basePath", f"{base}/runs").parquet(f"{base}/runs/batch=*"))


GRAPHS = """
hits AS (
  SELECT conv_id % 3 AS g, 1 AS source, 'chat_message' AS kind, 'm-' || conv_id || '-' || turn AS id, lower(text) AS t, CAST(turn AS BIGINT) AS seq FROM conversations
  UNION ALL SELECT doc_id % 3, 2, 'entity_summary', 'doc-' || doc_id, lower(text), 0 FROM documents WHERE text IS NOT NULL),
asked AS (SELECT * FROM (VALUES (0, 'q0', 0, 'Reaux', 3), (0, 'q0', 1, 'entre', 3), (0, 'q0', 2, 'zzzzz', 3), (0, 'q1', 0, 'tion', 1), (1, 'q0', 0, 'entre', 2), (1, 'q0', 1, 'tion', 2)) x(g, q, term, word, n)),
met AS (SELECT h.g, q, term, n, source, kind, id, row_number() OVER (PARTITION BY h.g, q, term, source ORDER BY seq DESC, id) AS pos
        FROM hits h JOIN asked a ON a.g = h.g AND contains(t, lower(word)) QUALIFY pos <= 10),
placed AS (SELECT *, row_number() OVER (PARTITION BY g, q, term ORDER BY source, pos) AS place FROM met QUALIFY place <= 10),
firsts AS (SELECT g, q, id, arg_min(kind, (term, place)) AS kind, min((term, place)) AS k FROM placed GROUP BY 1, 2, 3)"""


@query("K4_questions_by_graph", f"""
WITH {GRAPHS} SELECT 'g' || f.g AS graph_id, f.q AS question_id, id, kind, CAST(row_number() OVER (PARTITION BY f.g, f.q ORDER BY k) AS BIGINT) AS rank, round(c, 6) AS confidence
FROM firsts f JOIN (SELECT g, q, count(DISTINCT term) / max(n) AS c FROM placed GROUP BY 1, 2) s ON s.g = f.g AND s.q = f.q QUALIFY rank <= 10""")
def questions_by_graph(g):
    asked = g.spark.createDataFrame(
        [("g0", "q0", "What did I ask about the Reaux, entre or zzzzz before?"), ("g0", "q1", "tion"), ("g1", "q0", "about entre and tion"), ("g9", "q0", "tion")],
        "graph_id string, question_id string, question string",
    )
    messages = g.table("conversations").select(
        F.concat(F.lit("g"), (F.col("conv_id") % 3).cast("string")).alias("graph_id"), F.concat_ws("-", F.lit("m"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("content"), F.col("turn").cast("bigint").alias("seq"),
    )
    texts = g.table("documents").select(
        F.concat(F.lit("g"), (F.col("doc_id") % 3).cast("string")).alias("graph_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("summary")
    )
    return recall.recall_questions(messages, texts, asked).withColumn("confidence", F.round("confidence", 6))
