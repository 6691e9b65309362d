"""Analysis of derived facts: activation patterns, rule coverage, proof chains, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from knotwork.operators.loop import cut, cut_counting, keep_first, keep_last


def activation_patterns(nodes: DataFrame, edges: DataFrame, threshold: float | None = None) -> DataFrame:
    """Nodes strictly above the mean (or the threshold); those without outgoing edges are bottlenecks."""
    act = nodes.select("id", F.coalesce("activation", F.lit(0.0)).alias("activation"))
    mean = act.agg(F.coalesce(F.avg("activation"), F.lit(0.0))).scalar()
    limit = F.lit(threshold) if threshold is not None else mean
    high = act.filter(F.col("activation") > limit)
    out = edges.select(F.col("source").alias("id"), F.lit(True).alias("_out")).distinct()
    return (
        high.join(out, "id", "left").withColumn("bottleneck", F.col("_out").isNull()).drop("_out")
        .withColumn("mean_activation", mean).orderBy(F.desc("activation"), "id")
    )


def rule_coverage(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """Fires per rule, never fired, and fired less than the mean of the fired; unknown rules are ignored."""
    fires = facts.groupBy("rule_id").agg(F.count("*").alias("fires"))
    known = rules.select(F.col("id").alias("rule_id")).join(fires, "rule_id", "left")
    mean = known.agg(F.avg("fires")).scalar()
    return known.select(
        "rule_id", F.coalesce("fires", F.lit(0)).cast("bigint").alias("fires"), F.col("fires").isNull().alias("never_fired"),
        F.coalesce(F.col("fires") < mean, F.lit(False)).alias("under_activated"),
    )


def proof_depth(facts: DataFrame) -> DataFrame:
    return facts.agg(F.coalesce(F.max(F.size("proof_path")), F.lit(0)).cast("bigint").alias("max_proof_depth"))


def rule_usage(facts: DataFrame) -> DataFrame:
    return facts.groupBy("rule_id").agg(F.count("*").alias("uses"))


def circular_facts(facts: DataFrame) -> DataFrame:
    """Ids of the facts on any cycle; of parallel facts the last one counts.

    A fact lies on a cycle if source and target are in one strongly connected component.
    """
    from knotwork.operators.components import strong_components

    arcs = cut(keep_last(facts.select("source_id", "target_id", "id"), ["source_id", "target_id"], ["id"]))
    pairs = arcs.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    comp = strong_components(pairs)
    a = comp.select(F.col("id").alias("source_id"), F.col("component").alias("_a"))
    b = comp.select(F.col("id").alias("target_id"), F.col("component").alias("_b"))
    return arcs.join(a, "source_id").join(b, "target_id").filter(F.col("_a") == F.col("_b")).select("id")


def fact_impact(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """Facts reachable from each root fact along target to source, with breadth-first depth."""
    arcs = cut(facts.select("id", "source_id", "target_id"))
    start = arcs.join(roots.select("id"), "id", "left_semi").select(
        F.col("id").alias("root"), "id", "target_id", F.lit(0).cast("bigint").alias("depth")
    )
    seen = cut(start)
    frontier, depth = seen, 0
    while True:
        depth += 1
        reached = frontier.select("root", F.col("target_id").alias("source_id")).distinct()
        step = (
            reached.join(arcs, "source_id").select("root", "id", "target_id").distinct()
            .join(seen.select("root", "id"), ["root", "id"], "left_anti")
            .withColumn("depth", F.lit(depth).cast("bigint"))
        )
        frontier, counts = cut_counting(step, n=F.count("*"))
        if counts["n"] == 0:
            return seen.filter(F.col("depth") > 0).select("root", F.col("id").alias("fact_id"), "depth")
        seen = cut(seen.unionByName(frontier))
