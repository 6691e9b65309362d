"""Plain aggregates over nodes, edges, facts and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from knotwork.operators.loop import keep_first


def combo_support(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges per (edge type, source type, target type)."""
    src = nodes.select(F.col("id").alias("source"), F.col("type").alias("source_type"))
    tgt = nodes.select(F.col("id").alias("target"), F.col("type").alias("target_type"))
    return (
        edges.select("source", "target", F.col("type").alias("edge_type")).join(src, "source").join(tgt, "target")
        .groupBy("edge_type", "source_type", "target_type").agg(F.count("*").alias("support"))
    )


def combo_confidence(support: DataFrame) -> DataFrame:
    """Share of a combination among all edges that leave its source type."""
    total = F.sum("support").over(W.partitionBy("source_type"))
    return support.withColumn("confidence", F.col("support") / total)


def noisy_or(values: DataFrame, key: str, value: str, order: str, name: str = "confidence") -> DataFrame:
    """1 - prod(1 - value) per key, at most 1, multiplied in the given order.

    The array per key is as long as the number of rules that fire on one edge.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    rest = F.aggregate(ordered, F.lit(1.0), lambda acc, x: acc * (F.lit(1.0) - x["v"]))
    return values.groupBy(key).agg(F.least(F.lit(1.0), F.lit(1.0) - rest).alias(name))


def best_firing(values: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The row with the greatest value per key; the earlier one on ties."""
    return keep_first(values, [key], [(-F.col(value)).alias("_v"), F.col(order)])


def success_rate(outcomes: DataFrame, key: str, ok) -> DataFrame:
    return outcomes.groupBy(key).agg(
        F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("rate"), F.count("*").alias("outcomes")
    )


def fan_out(relationships: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Appearances of each name as source or target; a self loop counts twice."""
    keys = keys or []
    return (
        relationships.select(*keys, F.explode(F.array("source", "target")).alias("name"))
        .groupBy(*keys, "name").agg(F.count("*").alias("fanout"))
    )


def convergence_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """Largest change of activation over all ids of either side."""
    a = now.select("id", F.col("activation").alias("a"))
    b = before.select("id", F.col("activation").alias("b"))
    diff = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return a.join(b, "id", "full_outer").agg(F.coalesce(F.max(diff), F.lit(0.0)).alias("delta"))


def community_members(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("community_id").agg(F.count("*").alias("members"))


def repeat_successes(log: DataFrame, at_least: int = 3) -> DataFrame:
    return (
        log.filter(F.col("outcome") == "succeeded").groupBy("repository", "question")
        .agg(F.count("*").alias("successes")).filter(F.col("successes") >= at_least)
    )


def ingest_totals(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("entity_count"), F.lit(0)).cast("bigint").alias("entities")
    )


def rank_nodes(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """Scores with labels (the id if there is none), best first."""
    return (
        scores.join(nodes.select("id", "label"), "id", "left")
        .withColumn("label", F.coalesce("label", "id")).orderBy(F.desc("score"), "id")
    )


def top_activated(nodes: DataFrame, k: int = 10, floor: float = 0.01) -> DataFrame:
    return nodes.filter(F.col("activation") > floor).orderBy(F.desc("activation"), "id").limit(k)


def review_queue(items: DataFrame, status: str = "pending", by: str = "confidence") -> DataFrame:
    return items.filter(F.col("status") == status).orderBy(F.desc(by), "id")
