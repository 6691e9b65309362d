"""Incremental ingest and interval maintenance with Structured Streaming.

A micro-batch writes its validated rows under its batch number, so a batch that is tried again
after a failure replaces its own rows. The graph tables are views over the written log and equal
those of one batch over all documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from knotwork.operators.ingest import current_edges, current_nodes, ingest_log
from knotwork.operators.review import due_graphs
from knotwork.sources.ontology import Ontology

DOCUMENTS = "doc_id bigint, payload string, text string, source_doc string, at timestamp"
PARTS = ("nodes", "properties", "edges", "events", "links", "dropped")


def stream_ingest(spark: SparkSession, source: str, log: str, state: str, onto: Ontology, graph_id: str, files_per_batch: int | None = None) -> None:
    """Ingest the document files now in ``source`` that were not ingested before."""
    reader = spark.readStream.schema(DOCUMENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, number: int) -> None:
        parts = ingest_log(batch, onto, graph_id)
        for name in PARTS:
            getattr(parts, name).write.mode("overwrite").parquet(f"{log}/{name}/batch={number}")

    query = reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def read_log(spark: SparkSession, log: str, part: str) -> DataFrame:
    return spark.read.option("basePath", f"{log}/{part}").parquet(f"{log}/{part}/batch=*").drop("batch")


def stored_nodes(spark: SparkSession, log: str) -> DataFrame:
    return current_nodes(read_log(spark, log, "nodes"), read_log(spark, log, "properties"))


def stored_edges(spark: SparkSession, log: str) -> DataFrame:
    return current_edges(read_log(spark, log, "edges"))


def stream_maintenance(spark: SparkSession, schedules: str, schema: str, state: str, now, run: Callable[[DataFrame, int], None]) -> None:
    """Pass the graphs that are due among newly written schedule rows to ``run``; ends when all are done.

    Start it from the platform's own timer; the stream state keeps what was handled.
    """

    def each(batch: DataFrame, number: int) -> None:
        run(due_graphs(batch, now), number)

    query = spark.readStream.schema(schema).parquet(schedules).writeStream.foreachBatch(each).option(
        "checkpointLocation", state
    ).trigger(availableNow=True).start()
    query.awaitTermination()
