"""Graph, rule and ontology sources, and the table sinks."""
