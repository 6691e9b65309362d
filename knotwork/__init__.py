"""Knowledge-graph analytics as Spark DataFrame operators."""
