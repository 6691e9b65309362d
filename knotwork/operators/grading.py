"""Grading of outputs against assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def grade(assertions: DataFrame, outputs: DataFrame) -> DataFrame:
    """Add ``passed`` to assertions ``(case_id, type, value, text, subject, expected_type)``.

    ``outputs``, one row per case: entities and relationships (arrays of (name, type)), items (array
    of texts), error, iterations, converged_by, found. An unknown assertion type fails.
    """
    rows = assertions.join(outputs, "case_id", "left")
    kind = F.col("type")

    def size(column):
        return F.size(F.coalesce(column, F.array().cast(outputs.schema[column].dataType)))

    def first_type(column):
        hit = F.filter(column, lambda x: x["name"] == F.col("subject"))
        return F.when(F.size(hit) > 0, F.element_at(hit, 1)["type"])

    passed = (
        F.when(kind == "entity_count", size("entities") == F.col("value"))
        .when(kind == "relationship_count", size("relationships") == F.col("value"))
        .when(kind == "min_entity_count", size("entities") >= F.col("value"))
        .when(kind == "min_relationship_count", size("relationships") >= F.col("value"))
        .when(kind == "item_count", size("items") == F.col("value"))
        .when(kind == "min_item_count", size("items") >= F.col("value"))
        .when(kind == "entity_type_match", first_type("entities").eqNullSafe(F.col("expected_type")))
        .when(kind == "relationship_type_match", first_type("relationships").eqNullSafe(F.col("expected_type")))
        .when(kind == "no_error", F.col("error").isNull())
        .when(kind == "min_iterations", F.coalesce("iterations", F.lit(0)) >= F.col("value"))
        .when(kind == "converged", F.col("converged_by").isNotNull())
        .when(kind == "path_found", F.coalesce("found", F.lit(False)))
        .when(kind == "contains_text", F.exists("items", lambda x: F.contains(F.lower(x), F.lower("text"))))
    )
    return rows.select("case_id", "assertion_id", kind.alias("type"), F.coalesce(passed, F.lit(False)).alias("passed"))
