"""The knowledge graph built on the given tables, in Spark and in SQL.

Nodes: regions, nations, customers, suppliers, parts and size bands. Types of customers and
parts come from the data (market segment, part kind), so the ontology grows with it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from knotwork.operators.loop import cut

GRAPH = "tpch"
OWL = "http://www.w3.org/2002/07/owl#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
BASE = "http://example.org/kg#"

# The fixed upper part of the ontology: (uri, label) / (child, parent) / (label, domain, range).
CORE_CLASSES = """
  ('organization', 'organization'), ('party', 'party'), ('customer', 'Customer'), ('supplier', 'supplier'),
  ('jurisdiction', 'jurisdiction'), ('region', 'region'), ('nation', 'nation'), ('product', 'product'),
  ('part', 'part'), ('quantity-value', 'quantity value'), ('size-band', 'size band')
"""
CORE_SUBCLASS = """
  ('customer', 'party'), ('supplier', 'party'), ('party', 'organization'), ('region', 'jurisdiction'),
  ('nation', 'jurisdiction'), ('part', 'product'), ('size-band', 'quantity-value')
"""
CORE_PROPERTIES = """
  ('located', 'is located in', 'jurisdiction', 'region'),
  ('domiciled', 'is domiciled in', 'customer', 'jurisdiction'),
  ('supplies-value', 'supplies', 'supplier', 'quantity-value'),
  ('supplies', 'Supplies', 'organization', 'product'),
  ('purchases', 'purchases from', 'party', NULL),
  ('priced', 'is priced at', 'product', 'quantity-value')
"""
RULE_VALUES = """
  ('located-in', 'Place Located In', 'is located in', 'jurisdiction', 'jurisdiction', CAST(0.05 AS DOUBLE), CAST(0.8 AS DOUBLE), '{source} lies in {target}', 1),
  ('domiciled-in', 'Organization Domiciled In', 'is domiciled in', 'organization', 'jurisdiction', CAST(0.1 AS DOUBLE), CAST(1.0 AS DOUBLE), '{source} is domiciled in {target}', 2),
  ('buys', 'Party Buys From Supplier', 'purchases from', 'party', 'supplier', CAST(0.3 AS DOUBLE), CAST(0.9 AS DOUBLE), '{source} buys from {target}', 3),
  ('buys-org', 'Organization Deals With Organization', 'purchases from', 'organization', 'organization', CAST(0.3 AS DOUBLE), CAST(0.6 AS DOUBLE), '{source} deals with {target}', 4),
  ('supplies', 'Supplier Supplies Product', 'supplies', 'supplier', 'product', CAST(0.1 AS DOUBLE), CAST(0.7 AS DOUBLE), '{source} supplies {target}', 5),
  ('priced', 'Customer Priced At', 'is priced at', 'customer', 'quantity value', CAST(0.3 AS DOUBLE), CAST(0.5 AS DOUBLE), '{source} is priced at {target}', 6)
"""
RULE_COLUMNS = "id, name, edge_type, source_type, target_type, threshold, weight, description, ord"


class TpchGraph:
    """Lazy tables of the graph for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._schemas: dict = {}

    def table(self, name: str) -> DataFrame:
        """A given table. Its schema is read from the files once for this graph and given to later reads."""
        path = f"{self.folder}/{name}.parquet"
        known = self._schemas.get(path)
        out = self.spark.read.schema(known).parquet(path) if known is not None else self.spark.read.parquet(path)
        self._schemas.setdefault(path, out.schema)
        return out

    def _nodes(self, table: str, key: str, label, type_, prefix: str, props) -> DataFrame:
        return self.table(table).select(
            F.lit(GRAPH).alias("graph_id"),
            F.concat(F.lit(f"{GRAPH}:{prefix}-"), F.col(key).cast("string")).alias("id"),
            label.alias("label"),
            type_.alias("type"),
            F.lit(table).alias("source_doc"),
            F.lit(1.0).alias("extraction_confidence"),
            props.alias("properties"),
        )

    @cached_property
    def entities(self) -> DataFrame:
        none = F.expr("cast(map() as map<string,string>)")
        parts = self.table("part")
        bands = (
            parts.select(F.floor(F.col("p_size") / 10).cast("bigint").alias("band")).distinct().select(
                F.lit(GRAPH).alias("graph_id"),
                F.concat(F.lit(f"{GRAPH}:size-"), F.col("band").cast("string")).alias("id"),
                F.concat(F.lit("size band "), F.col("band").cast("string")).alias("label"),
                F.lit("size band").alias("type"),
                F.lit("part").alias("source_doc"),
                F.lit(1.0).alias("extraction_confidence"),
                none.alias("properties"),
            )
        )
        frames = [
            self._nodes("region", "r_regionkey", F.col("r_name"), F.lit("region"), "region", none),
            self._nodes("nation", "n_nationkey", F.col("n_name"), F.lit("nation"), "nation", none),
            self._nodes(
                "customer", "c_custkey", F.col("c_name"),
                F.concat(F.lower("c_mktsegment"), F.lit(" customer")), "customer",
                F.create_map(F.lit("segment"), F.col("c_mktsegment")),
            ),
            self._nodes("supplier", "s_suppkey", F.col("s_name"), F.lit("supplier"), "supplier", none),
            self._nodes(
                "part", "p_partkey", F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")),
                F.concat(F.lower("p_type"), F.lit(" part")), "part",
                F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type")),
            ),
            bands,
        ]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out.select(
            "*",
            F.lit(None).cast("double").alias("activation"),
            F.lit(False).alias("derived"),
            F.lit(None).cast("double").alias("salience"),
            F.lit(None).cast("string").alias("note"),
            F.lit(None).cast("string").alias("summary"),
            F.lit(None).cast("bigint").alias("community_id"),
            F.lit(None).cast("double").alias("centrality_score"),
        )

    def _edge(self, df: DataFrame, source, target, type_: str, weight) -> DataFrame:
        return df.select(
            F.lit(GRAPH).alias("graph_id"),
            F.concat(source, F.lit("->"), F.regexp_replace(F.lit(type_), " ", "-"), F.lit("->"), target).alias("id"),
            source.alias("source"),
            target.alias("target"),
            F.lit(type_).alias("type"),
            weight.alias("weight"),
        )

    @staticmethod
    def node(prefix: str, key: str):
        return F.concat(F.lit(f"{GRAPH}:{prefix}-"), F.col(key).cast("string"))

    @cached_property
    def place_edges(self) -> DataFrame:
        n = self.node
        located = self._edge(
            self.table("nation"), n("nation", "n_nationkey"), n("region", "n_regionkey"), "is located in", F.lit(1.0)
        )
        customers = self._edge(
            self.table("customer"), n("customer", "c_custkey"), n("nation", "c_nationkey"), "is domiciled in", F.lit(0.9)
        )
        suppliers = self._edge(
            self.table("supplier"), n("supplier", "s_suppkey"), n("nation", "s_nationkey"), "is domiciled in", F.lit(0.9)
        )
        return located.unionByName(customers).unionByName(suppliers)

    @cached_property
    def trade_edges(self) -> DataFrame:
        n = self.node
        lines = self.table("lineitem")
        supply = lines.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("v"))
        supply = supply.withColumn("w", F.round(F.col("v") / supply.agg(F.max("v")).scalar(), 6))
        bought = (
            self.table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy("o_custkey", "l_suppkey").agg(F.count("*").cast("double").alias("v"))
        )
        bought = bought.withColumn("w", F.round(F.col("v") / bought.agg(F.max("v")).scalar(), 6))
        return self._edge(
            supply, n("supplier", "l_suppkey"), n("part", "l_partkey"), "supplies", F.col("w")
        ).unionByName(
            self._edge(bought, n("customer", "o_custkey"), n("supplier", "l_suppkey"), "purchases from", F.col("w"))
        )

    @cached_property
    def edges(self) -> DataFrame:
        n = self.node
        priced = self._edge(
            self.table("part").withColumn("band", F.floor(F.col("p_size") / 10).cast("bigint")),
            n("part", "p_partkey"), n("size", "band"), "is priced at", F.lit(1.0),
        )
        return self.place_edges.unionByName(self.trade_edges).unionByName(priced).select(
            "*",
            F.lit(None).cast("timestamp").alias("valid_at"),
            F.lit(None).cast("timestamp").alias("invalid_at"),
            F.lit(None).cast("string").alias("produced_by_event_id"),
        )

    @cached_property
    def order_links(self) -> DataFrame:
        """Customer to part links of all orders, a sparse graph that grows with the data."""
        n = self.node
        pairs = (
            self.table("orders").join(self.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
            .select("o_custkey", "l_partkey").distinct()
        )
        return self._edge(pairs, n("customer", "o_custkey"), n("part", "l_partkey"), "orders", F.lit(1.0))

    @cached_property
    def place_nodes(self) -> DataFrame:
        return self.entities.filter(F.col("source_doc") != "part")

    @cached_property
    def rdf(self) -> DataFrame:
        """The ontology as RDF triples: a fixed upper part, and classes found in the tables."""
        v = self.spark.sql
        classes = v(f"SELECT concat('{BASE}', u) s, l FROM VALUES {CORE_CLASSES} t(u, l)")
        sub = v(f"SELECT concat('{BASE}', c) s, '{RDFS}subClassOf' p, concat('{BASE}', q) o FROM VALUES {CORE_SUBCLASS} t(c, q)")
        props = v(
            f"SELECT concat('{BASE}', u) s, l, concat('{BASE}', d) d, concat('{BASE}', r) r "
            f"FROM VALUES {CORE_PROPERTIES} t(u, l, d, r)"
        )
        kinds = self.table("part").select(F.lower("p_type").alias("k")).distinct()
        segments = self.table("customer").select(F.lower("c_mktsegment").alias("k")).distinct()
        brands = self.table("part").select("p_brand").distinct()

        def spo(df, s, p, o):
            return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))

        c, b = F.col, F.lit(BASE)
        cls = F.lit(OWL + "Class")
        kind_uri = F.concat(b, F.lit("part-"), c("k"))
        seg_uri = F.concat(b, F.lit("customer-"), c("k"))
        brand_uri = F.concat(F.lit("http://example.org/brands/"), c("p_brand"))
        frames = [
            spo(classes, c("s"), RDF + "type", cls),
            spo(classes, c("s"), RDFS + "label", c("l")),
            sub,
            spo(props, c("s"), RDF + "type", F.lit(OWL + "ObjectProperty")),
            spo(props, c("s"), RDFS + "label", c("l")),
            spo(props.filter("d is not null"), c("s"), RDFS + "domain", c("d")),
            spo(props.filter("r is not null"), c("s"), RDFS + "range", c("r")),
            spo(kinds, kind_uri, RDF + "type", cls),
            spo(kinds, kind_uri, RDFS + "label", F.concat(c("k"), F.lit(" part"))),
            spo(kinds, kind_uri, RDFS + "subClassOf", F.lit(BASE + "part")),
            spo(segments, seg_uri, RDF + "type", cls),
            spo(segments, seg_uri, RDFS + "label", F.concat(c("k"), F.lit(" customer"))),
            spo(segments, seg_uri, RDFS + "subClassOf", F.lit(BASE + "customer")),
            spo(brands, brand_uri, RDF + "type", cls),
            spo(brands, F.concat(F.lit("_:"), c("p_brand")), RDF + "type", cls),
            spo(brands, brand_uri, RDFS + "subClassOf", F.lit(BASE + "product")),
        ]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    @cached_property
    def ontology(self):
        from knotwork.sources.ontology import load_schema

        return load_schema(cut(self.rdf))

    @cached_property
    def rules(self) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM VALUES {RULE_VALUES} t({RULE_COLUMNS})")

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            F.lit(GRAPH).alias("graph_id"),
            F.col("conv_id").cast("string").alias("session_id"),
            F.concat_ws("-", F.lit("m"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
            "role", F.col("text").alias("content"), F.col("turn").cast("bigint").alias("seq"),
        )

    @cached_property
    def assertions(self) -> DataFrame:
        """Each event says which action a user did last."""
        return self.table("events").select(
            F.lit(GRAPH).alias("graph_id"),
            F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"),
            F.lit("last action").alias("type"),
            F.col("event_type").alias("target"),
            F.col("value").alias("weight"),
            F.col("ts").alias("at"),
            F.col("event_id").cast("bigint").alias("ord"),
            F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.lit(GRAPH).alias("graph_id"),
            F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"),
            F.concat(F.lit("kind "), F.col("label").cast("string")).alias("type"),
            F.concat(F.lit("Item "), F.col("label").cast("string"), F.lit(" Corp")).alias("label"),
            F.col("embedding").cast("array<double>").alias("vector"),
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        """Review decisions: one per labelled document, for a rule chosen by its source."""
        docs = self.table("documents").select("doc_id", "source")
        return self.table("labels").join(docs, "doc_id").select(
            F.concat(F.lit("rule-"), F.col("source")).alias("rule_id"),
            F.when(F.col("quality") == 1, "confirmed").otherwise("rejected").alias("outcome"),
            F.col("doc_id").cast("bigint").alias("ord"),
        )


# The same graph in SQL.
KG_SQL = f"""
bands AS (SELECT DISTINCT CAST(floor(p_size / 10) AS BIGINT) AS band FROM part),
entities AS MATERIALIZED (
  SELECT '{GRAPH}:region-' || r_regionkey AS id, r_name AS label, 'region' AS type, 'region' AS source_doc FROM region
  UNION ALL SELECT '{GRAPH}:nation-' || n_nationkey, n_name, 'nation', 'nation' FROM nation
  UNION ALL SELECT '{GRAPH}:customer-' || c_custkey, c_name, lower(c_mktsegment) || ' customer', 'customer' FROM customer
  UNION ALL SELECT '{GRAPH}:supplier-' || s_suppkey, s_name, 'supplier', 'supplier' FROM supplier
  UNION ALL SELECT '{GRAPH}:part-' || p_partkey, p_name || ' #' || p_partkey, lower(p_type) || ' part', 'part' FROM part
  UNION ALL SELECT '{GRAPH}:size-' || band, 'size band ' || band, 'size band', 'part' FROM bands),
supply AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
bought AS (SELECT o_custkey, l_suppkey, CAST(count(*) AS DOUBLE) AS v
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
raw_edges AS (
  SELECT '{GRAPH}:nation-' || n_nationkey AS source, '{GRAPH}:region-' || n_regionkey AS target,
         'is located in' AS type, CAST(1.0 AS DOUBLE) AS weight FROM nation
  UNION ALL SELECT '{GRAPH}:customer-' || c_custkey, '{GRAPH}:nation-' || c_nationkey, 'is domiciled in', 0.9 FROM customer
  UNION ALL SELECT '{GRAPH}:supplier-' || s_suppkey, '{GRAPH}:nation-' || s_nationkey, 'is domiciled in', 0.9 FROM supplier
  UNION ALL SELECT '{GRAPH}:supplier-' || l_suppkey, '{GRAPH}:part-' || l_partkey, 'supplies',
         round(v / (SELECT max(v) FROM supply), 6) FROM supply
  UNION ALL SELECT '{GRAPH}:customer-' || o_custkey, '{GRAPH}:supplier-' || l_suppkey, 'purchases from',
         round(v / (SELECT max(v) FROM bought), 6) FROM bought
  UNION ALL SELECT '{GRAPH}:part-' || p_partkey, '{GRAPH}:size-' || CAST(floor(p_size / 10) AS BIGINT), 'is priced at', 1.0 FROM part),
edges AS MATERIALIZED (
  SELECT source || '->' || replace(type, ' ', '-') || '->' || target AS id, source, target, type, weight FROM raw_edges),
rules AS (SELECT * FROM (VALUES {RULE_VALUES}) t({RULE_COLUMNS}))"""

ONTO_SQL = f"""
class_rows AS (
  SELECT '{BASE}' || u AS uri, l AS label FROM (VALUES {CORE_CLASSES}) t(u, l)
  UNION SELECT '{BASE}part-' || lower(p_type), lower(p_type) || ' part' FROM part
  UNION SELECT '{BASE}customer-' || lower(c_mktsegment), lower(c_mktsegment) || ' customer' FROM customer
  UNION SELECT 'http://example.org/brands/' || p_brand, split_part(p_brand, '#', 2) FROM part),
sub_rows AS (
  SELECT '{BASE}' || c AS child_uri, '{BASE}' || q AS parent_uri FROM (VALUES {CORE_SUBCLASS}) t(c, q)
  UNION SELECT '{BASE}part-' || lower(p_type), '{BASE}part' FROM part
  UNION SELECT '{BASE}customer-' || lower(c_mktsegment), '{BASE}customer' FROM customer
  UNION SELECT 'http://example.org/brands/' || p_brand, '{BASE}product' FROM part),
property_rows AS (
  SELECT '{BASE}' || u AS uri, l AS label, '{BASE}' || d AS domain, '{BASE}' || r AS range
  FROM (VALUES {CORE_PROPERTIES}) t(u, l, d, r)),
reach AS (
  SELECT child_uri AS c, parent_uri AS p FROM sub_rows
  UNION SELECT r.c, s.parent_uri FROM reach r JOIN sub_rows s ON s.child_uri = r.p),
label_closure AS MATERIALIZED (
  SELECT DISTINCT lower(a.label) AS child, lower(b.label) AS parent
  FROM reach JOIN class_rows a ON a.uri = c JOIN class_rows b ON b.uri = p
  UNION SELECT lower(label), lower(label) FROM class_rows)"""


def kg_sql(body: str, *more: str, onto: bool = False) -> str:
    """A query over the graph tables; ``more`` are further named subqueries."""
    parts = [KG_SQL] + ([ONTO_SQL] if onto else []) + list(more)
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n" + body


def onto_sql(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in [ONTO_SQL, *more]) + "\n" + body
