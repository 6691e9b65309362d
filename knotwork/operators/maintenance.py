"""One maintenance pass over a graph: mine, reason, resolve, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from knotwork.operators.loop import cut, stored
from knotwork.operators.mining import mine_candidates
from knotwork.operators.ontology import label_closure
from knotwork.operators.reasoning import Reasoning, run_reasoning
from knotwork.operators.resolution import duplicate_candidates
from knotwork.sources.ontology import Ontology


def summary(graph_id: str, mined: DataFrame, result: Reasoning | None, duplicates: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: counts, rounds, how reasoning ended, and the weights of the rules that fired."""
    row = mined.agg(F.lit(graph_id).alias("graph_id"), F.count("*").alias("mined_candidates"))
    row = row.withColumn("duplicate_candidates", duplicates.agg(F.count("*")).scalar())
    if result is None:
        none = F.lit(None)
        return row.withColumns({
            "reasoning_ran": F.lit(False), "iterations": none.cast("bigint"), "new_facts": F.lit(0).cast("bigint"),
            "converged_by": none.cast("string"), "active_rule_weights": F.expr("cast(map() as map<string,double>)"),
        })
    fired = rules.join(result.facts.select(F.col("rule_id").alias("id")).distinct(), "id", "left_semi")
    weights = fired.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "weight"))))).scalar()
    return row.withColumns({
        "reasoning_ran": F.lit(True), "iterations": F.lit(result.iterations).cast("bigint"),
        "new_facts": result.facts.agg(F.count("*")).scalar(), "converged_by": F.lit(result.converged_by), "active_rule_weights": weights,
    })


def run_maintenance(graph_id: str, nodes, edges, rules, onto: Ontology, covered: DataFrame, vectors: DataFrame, **settings):
    """Mined candidates, reasoning result, duplicate candidates and the summary row.

    Every output has ids built from its content, so a second pass gives the same rows.
    """
    nodes, edges = stored(nodes), stored(edges)
    mined = cut(mine_candidates(nodes, edges, covered, **settings))
    result = None if nodes.isEmpty() else run_reasoning(nodes, edges, rules, onto)
    duplicates = cut(duplicate_candidates(vectors, label_closure(onto)))
    return mined, result, duplicates, summary(graph_id, mined, result, duplicates, rules)


def maintain_due(due: DataFrame, graph: Callable[[str], tuple], runs: str, number: int) -> None:
    """A maintenance pass for each graph of ``due`` (graph_id), and its summary among the ``runs``.

    ``graph`` gives (nodes, edges, rules, ontology, covered, vectors) of a graph. The rows of a batch are written under
    its number, so a batch that is tried again replaces its own rows. One graph follows the other; each is a Spark job.
    """
    done = None
    for row in due.select("graph_id").distinct().orderBy("graph_id").toLocalIterator():
        part = run_maintenance(row["graph_id"], *graph(row["graph_id"]))[3]
        done = part if done is None else done.unionByName(part)
    if done is not None:
        done.write.mode("overwrite").parquet(f"{runs}/batch={number}")


def last_runs(runs: DataFrame, schedules: DataFrame, now) -> DataFrame:
    """``schedules`` with the time of the passes in ``runs`` as last_run_at."""
    ran = runs.select("graph_id").distinct().withColumn("_ran", now)
    return schedules.join(ran, "graph_id", "left").withColumn("last_run_at", F.coalesce("_ran", "last_run_at")).drop("_ran")
