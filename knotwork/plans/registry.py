"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from knotwork.plans.tpch_graph import TpchGraph

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
#: Rows of the largest table for each partition of a shuffle before adaptive execution merges small ones.
ROWS = 1 << 18
#: Bytes of shuffled rows that adaptive execution merges into one task, and bytes of a file that one task scans, at most.
#: Rows take some ten times as much in the hash tables and sorts of a task.
MERGED, SCANNED = "16m", "32m"


def fit_shuffles(graph: TpchGraph) -> None:
    """Shuffles start with partitions in proportion to the largest table, and small ones are merged up to a fixed size, so
    that a task's share does not grow with the tables."""
    conf = graph.spark.conf
    rows = graph.table("lineitem").count()  # from the Parquet footers
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", MERGED)
    conf.set("spark.sql.files.maxPartitionBytes", SCANNED)


def query(name: str, sql: str | None = None):
    """Register ``fn(graph) -> DataFrame`` under ``name`` with the SQL that gives the same rows."""

    def add(fn: Callable[[TpchGraph], DataFrame]):
        def run(spark, folder):
            graph = TpchGraph(spark, folder)
            fit_shuffles(graph)
            return fn(graph)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add
