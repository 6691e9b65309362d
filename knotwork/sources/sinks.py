"""Updates of the stored tables, and the writer.

Every update returns the new table; ``write_table`` stores it partitioned by graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from knotwork.operators.loop import keep_last


def write_table(df: DataFrame, path: str, partition_by: str | None = "graph_id") -> None:
    """Write a table as Parquet. ``path`` must not be one the frame reads from.

    With ``partition_by`` only the graphs that ``df`` holds are replaced, others stay.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_scores(entities: DataFrame, scores: DataFrame, column: str) -> DataFrame:
    """Put ``scores(id, score)`` in a node column; nodes without a score keep theirs."""
    new = scores.select("id", F.col("score").alias("_new"))
    return entities.join(new, "id", "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def apply_activation(entities: DataFrame, activation: DataFrame) -> DataFrame:
    """Store activation for ids that have a node row."""
    return write_scores(entities, activation.withColumnRenamed("activation", "score"), "activation")


def clear_activation(entities: DataFrame) -> DataFrame:
    return entities.withColumn("activation", F.lit(0.0))


def save_facts(stored: DataFrame, new: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert facts by id and flag their targets as derived.

    A fact that was fed back stays fed back when it is saved again.
    """
    old = stored.withColumn("_new", F.lit(0))
    fresh = new.withColumn("_new", F.lit(1))
    for name in ("fed_back", "review_status"):
        if name not in fresh.columns:
            fresh = fresh.withColumn(name, F.lit(None).cast(stored.schema[name].dataType))
    both = old.unionByName(fresh.select(*old.columns))
    keep = both.groupBy("id").agg(
        F.bool_or(F.coalesce("fed_back", F.lit(False))).alias("_fed"),
        F.max("review_status").alias("_status"),
    )
    facts = (
        keep_last(both, ["id"], ["_new", "iteration"]).drop("_new", "fed_back", "review_status")
        .join(keep, "id").withColumnsRenamed({"_fed": "fed_back", "_status": "review_status"})
    )
    return facts, flag_derived(entities, new)


def flag_derived(entities: DataFrame, facts: DataFrame) -> DataFrame:
    hit = facts.select(F.col("target_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return (
        entities.join(hit, "id", "left")
        .withColumn("derived", F.coalesce("_hit", F.col("derived"), F.lit(False))).drop("_hit")
    )


def clear_facts(facts: DataFrame, entities: DataFrame, graph_id: str) -> tuple[DataFrame, DataFrame]:
    """Drop the facts of a graph and reset the derived flag of their targets."""
    gone = facts.filter(F.col("graph_id") == graph_id)
    kept = facts.filter(F.col("graph_id") != graph_id)
    hit = gone.select(F.col("target_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    nodes = (
        entities.join(hit, "id", "left")
        .withColumn("derived", F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("derived"))).drop("_hit")
    )
    return kept, nodes


def mark_fed_back(facts: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return (
        facts.join(hit, "id", "left")
        .withColumn("fed_back", F.coalesce("_hit", F.col("fed_back"), F.lit(False))).drop("_hit")
    )


def update_metadata(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial update: only given values replace; properties are replaced whole."""
    fields = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
    out = entities.join(new, "id", "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).drop(*[f"_{c}" for c in fields])


def set_properties(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Merge ``changes(id, key, value, ord)`` into the property maps; the last value of a key wins."""
    last = keep_last(changes, ["id", "key"], ["ord"])
    new = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_new"))
    old = F.coalesce("properties", F.expr("cast(map() as map<string,string>)"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key("_new", k)), F.col("_new"))
    return (
        entities.join(new, "id", "left")
        .withColumn("properties", F.when(F.col("_new").isNotNull(), merged).otherwise(old)).drop("_new")
    )
