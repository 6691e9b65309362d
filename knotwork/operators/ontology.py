"""Subclass closure, domain and range checks, roles, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from knotwork.operators.loop import cut, cut_counting
from knotwork.sources.ontology import Ontology

# Anchor class, role and position, and the weight of each role.
ROLE_ANCHORS = [("quantity value", "value", 1), ("time instant", "temporal", 2)]
ROLE_WEIGHTS = {"actor": 1.0, "event": 1.0, "value": 0.0, "temporal": 0.0, "metadata": 0.0}


def uri_closure(subclass: DataFrame) -> DataFrame:
    """All (child_uri, parent_uri) pairs along one or more steps. Cycles end, because only new pairs go on.

    Each round doubles the path length, so the rounds grow with the logarithm of the depth.
    """
    known = cut(subclass.select("child_uri", "parent_uri").distinct())
    while True:
        left = known.select("child_uri", F.col("parent_uri").alias("_mid"))
        right = known.select(F.col("child_uri").alias("_mid"), "parent_uri")
        steps = left.join(right, "_mid").select("child_uri", "parent_uri", F.lit(True).alias("fresh"))
        both = known.withColumn("fresh", F.lit(False)).unionByName(steps)
        known, seen = cut_counting(
            both.groupBy("child_uri", "parent_uri").agg(F.bool_and("fresh").alias("fresh")), n=F.count_if("fresh")
        )
        known = known.drop("fresh")
        if seen["n"] == 0:
            return known


def label_closure(onto: Ontology) -> DataFrame:
    """(child, parent) pairs of lower-case labels, each label with itself included."""
    names = onto.classes.select("uri", F.lower("label").alias("label")).distinct()
    child = names.select(F.col("uri").alias("child_uri"), F.col("label").alias("child"))
    parent = names.select(F.col("uri").alias("parent_uri"), F.col("label").alias("parent"))
    pairs = uri_closure(onto.subclass).join(child, "child_uri").join(parent, "parent_uri").select("child", "parent")
    same = names.select(F.col("label").alias("child"), F.col("label").alias("parent"))
    synonyms = child.join(parent, F.col("child_uri") == F.col("parent_uri")).select("child", "parent")
    return cut(pairs.unionByName(same).unionByName(synonyms).distinct())


def mark_subclass(rows: DataFrame, candidate: str, expected: str, closure: DataFrame, flag: str) -> DataFrame:
    """Add ``flag``: candidate IS-A expected, in any case; equal labels match even if unknown."""
    pairs = closure.select(F.col("child").alias("_c"), F.col("parent").alias("_p"), F.lit(True).alias("_hit"))
    joined = rows.join(
        pairs, (F.lower(F.col(candidate)) == F.col("_c")) & (F.lower(F.col(expected)) == F.col("_p")), "left"
    )
    same = F.lower(F.col(candidate)) == F.lower(F.col(expected))
    return joined.withColumn(flag, F.coalesce(F.col("_hit"), same, F.lit(False))).drop("_c", "_p", "_hit")


def domain_range_valid(combos: DataFrame, onto: Ontology, closure: DataFrame) -> DataFrame:
    """Add ``valid`` to distinct (edge_type, source_type, target_type) rows.

    Any property of that label may accept the types; an unknown property or an undeclared side passes.
    """
    names = onto.classes.groupBy("uri").agg(F.max("label").alias("label"))
    props = (
        onto.properties.select(F.lower("label").alias("_prop"), "domain", "range")
        .join(names.select(F.col("uri").alias("domain"), F.col("label").alias("_domain")), "domain", "left")
        .join(names.select(F.col("uri").alias("range"), F.col("label").alias("_range")), "range", "left")
        .select("_prop", "_domain", "_range", F.lit(True).alias("_known"))
    )
    rows = combos.join(props, F.lower("edge_type") == F.col("_prop"), "left")
    rows = mark_subclass(rows, "source_type", "_domain", closure, "_d")
    rows = mark_subclass(rows, "target_type", "_range", closure, "_r")
    ok = (
        F.col("_known").isNull()
        | ((F.col("_domain").isNull() | F.col("_d")) & (F.col("_range").isNull() | F.col("_r")))
    )
    return rows.groupBy("edge_type", "source_type", "target_type").agg(F.bool_or(ok).alias("valid"))


def type_roles(types: DataFrame, closure: DataFrame, anchors=ROLE_ANCHORS) -> DataFrame:
    """Role of each distinct ``type``: that of the first anchor it IS-A, null if none."""
    spark = types.sparkSession
    table = spark.createDataFrame(anchors, "anchor string, role string, pos int")
    rows = types.select("type").distinct()
    hits = (
        closure.join(table, F.col("parent") == F.lower("anchor")).groupBy("child")
        .agg(F.min_by("role", "pos").alias("role"))
    )
    own = table.select(F.lower("anchor").alias("child"), F.col("role").alias("own"))
    return (
        rows.join(hits, F.lower("type") == F.col("child"), "left").drop("child")
        .join(own, F.lower("type") == F.col("child"), "left")
        .select("type", F.coalesce("role", "own").alias("role"))
    )


def apply_role_weights(scores: DataFrame, nodes: DataFrame, closure: DataFrame, weights=ROLE_WEIGHTS) -> DataFrame:
    """Multiply node scores by the weight of the node type's role; 1 if there is no role."""
    roles = type_roles(nodes.select("type"), closure)
    table = nodes.sparkSession.createDataFrame(list(weights.items()), "role string, w double")
    per_type = roles.join(table, "role", "left").select("type", F.coalesce("w", F.lit(1.0)).alias("w"))
    return (
        scores.join(nodes.select("id", "type"), "id", "left").join(per_type, "type", "left")
        .select("id", (F.col("score") * F.coalesce("w", F.lit(1.0))).alias("score"))
    )


def ontology_listing(onto: Ontology) -> DataFrame:
    """Distinct class and property labels and label-level subclass pairs (the URI if unlabelled)."""
    names = onto.classes.groupBy("uri").agg(F.max("label").alias("label"))
    pairs = (
        onto.subclass.join(names.select(F.col("uri").alias("child_uri"), F.col("label").alias("c")), "child_uri", "left")
        .join(names.select(F.col("uri").alias("parent_uri"), F.col("label").alias("p")), "parent_uri", "left")
        .select(
            F.lit("subclass").alias("kind"), F.coalesce("c", "child_uri").alias("label"),
            F.coalesce("p", "parent_uri").alias("parent"),
        )
    )
    none = F.lit(None).cast("string").alias("parent")
    classes = onto.classes.select(F.lit("class").alias("kind"), "label", none)
    properties = onto.properties.select(F.lit("property").alias("kind"), "label", none)
    return classes.unionByName(properties).unionByName(pairs).distinct().orderBy("kind", "label", "parent")
