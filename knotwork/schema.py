"""Table schemas of the graph model."""

from __future__ import annotations

ENTITIES = (
    "graph_id string, id string, label string, type string, source_doc string, "
    "extraction_confidence double, activation double, derived boolean, salience double, "
    "properties map<string,string>, note string, summary string, community_id bigint, "
    "centrality_score double"
)
EDGES = (
    "graph_id string, id string, source string, target string, type string, weight double, "
    "valid_at timestamp, invalid_at timestamp, produced_by_event_id string"
)
PROOF_STEP = (
    "struct<rule_name:string, edge_type:string, source_label:string, target_label:string, "
    "premise_activation:double, iteration:int, type_resolution:string>"
)
FACTS = (
    "id string, rule_id string, rule_name string, source_id string, target_id string, "
    "edge_id string, edge_type string, fact string, confidence double, iteration int, "
    f"first_rule_ord int, proof_path array<{PROOF_STEP}>, "
    "supporting_rule_ids array<string>, contributing_fact_ids array<string>"
)
TRIPLES = "subject string, predicate string, object string, derived boolean, confidence double, ord string"
CLASSES = "uri string, label string, ord int"
PROPERTIES = "uri string, label string, domain string, range string, ord int"
SUBCLASS = "child_uri string, parent_uri string"
ACTIVATION = "id string, activation double"
EXTRACTION = (
    "struct<entities:array<struct<name:string,type:string,confidence:string>>,"
    "relationships:array<struct<source:string,relation:string,target:string,confidence:string>>>"
)
HEURISTIC = "struct<facts:array<struct<text:string,anchors:array<string>,confidence:string>>>"
