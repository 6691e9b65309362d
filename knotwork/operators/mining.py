"""Rule mining: repeated edge patterns become rule candidates for review."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from knotwork.operators.counting import combo_confidence, combo_support

COMBO = ["edge_type", "source_type", "target_type"]
MINED_THRESHOLD = 0.3


def covered_combos(rules: DataFrame, rejected: DataFrame) -> DataFrame:
    return rules.select(*COMBO).union(rejected.select(*COMBO)).distinct()


def mine_candidates(
    nodes: DataFrame, edges: DataFrame, covered: DataFrame, min_support: int = 3, min_confidence: float = 0.6
) -> DataFrame:
    """Combinations with enough support and confidence that no rule or rejection covers."""
    found = combo_confidence(combo_support(edges, nodes)).filter(
        (F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)
    )
    return found.join(covered, COMBO, "left_anti").select(
        F.concat_ws("-", F.lit("cand"), *COMBO).alias("id"), *COMBO, "support", "confidence"
    ).orderBy(F.desc("confidence"), "id")


def promote(candidates: DataFrame) -> DataFrame:
    """Approved candidates as rules; the mined confidence is the first weight."""
    text = F.concat(
        F.lit("{source} "), "edge_type", F.lit(" {target} (mined, support="), F.col("support").cast("string"), F.lit(")")
    )
    return candidates.filter(F.col("status") == "approved").select(
        F.concat(F.lit("mined-"), "id").alias("id"), F.concat(F.lit("Mined: "), "edge_type").alias("name"),
        *COMBO, F.lit(MINED_THRESHOLD).alias("threshold"), F.col("confidence").alias("weight"),
        text.alias("description"),
    )
