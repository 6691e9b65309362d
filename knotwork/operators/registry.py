"""Algorithms by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from knotwork.operators import centrality
from knotwork.operators.ontology import apply_role_weights, label_closure
from knotwork.operators.projection import project
from knotwork.sources.ontology import Ontology


@dataclass(frozen=True)
class Algorithm:
    name: str
    category: str
    run: Callable[..., DataFrame]   # (nodes, edges, **params) -> (id, score)
    params: dict = field(default_factory=dict)
    chart: str | None = None


ALGORITHMS: dict[str, Algorithm] = {}


def register(algorithm: Algorithm) -> None:
    ALGORITHMS[algorithm.name] = algorithm


register(Algorithm("degree_centrality", "centrality", centrality.degree, chart="bar"))
register(Algorithm("pagerank", "centrality", centrality.pagerank, {"alpha": 0.85}, "bar"))
register(Algorithm("betweenness_centrality", "centrality", centrality.betweenness, chart="bar"))
register(Algorithm("closeness_centrality", "centrality", centrality.closeness, chart="bar"))


def run_algorithm(nodes: DataFrame, edges: DataFrame, name: str = "degree_centrality", onto: Ontology | None = None) -> DataFrame:
    """Scores of a named algorithm; centrality scores are weighted by role if an ontology is given.

    No rows for an empty graph or an unknown name.
    """
    known = ALGORITHMS.get(name)
    if known is None or nodes.isEmpty():
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    scores = known.run(nodes, project(edges), **known.params)
    if onto is not None and known.category == "centrality":
        scores = apply_role_weights(scores, nodes, label_closure(onto))
    return scores
