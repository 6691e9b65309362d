"""The graph built on the given tables, and the registered queries with their SQL."""
