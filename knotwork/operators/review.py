"""Human review: decisions, weights from outcomes, few-shot promotion, schedules, memory order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from knotwork.operators.counting import repeat_successes, success_rate
from knotwork.operators.loop import keep_last
from knotwork.operators.ranking import number_rows, top_k

STATUSES = ["pending", "approved", "rejected"]
OUTCOMES = ["confirmed", "rejected"]
MIN_INTERVAL = 5
DEFAULT_INTERVAL = 60


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last valid decision per item; ``decisions``: id, status, reviewed_at, ord."""
    valid = decisions.filter(F.col("status").isin(STATUSES))
    return keep_last(valid.select("id", "status", "reviewed_at", "ord"), ["id"], ["reviewed_at", "ord"])


def with_status(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with their decided status, pending by default. Re-made items keep their decision."""
    return items.join(latest_decisions(decisions).select("id", "status"), "id", "left").withColumn(
        "status", F.coalesce("status", F.lit("pending"))
    )


def bad_decisions(decisions: DataFrame) -> DataFrame:
    return decisions.filter(~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)))


def rule_weights(rules: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rules with the share of confirmed facts as weight; rules without outcomes keep theirs."""
    rate = success_rate(outcomes.filter(F.col("outcome").isin(OUTCOMES)), "rule_id", F.col("outcome") == "confirmed")
    return (
        rules.join(rate.select(F.col("rule_id").alias("id"), "rate"), "id", "left")
        .withColumn("weight", F.coalesce("rate", "weight")).drop("rate")
    )


def review_facts(facts: DataFrame, rules: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply reviews ``(fact_id, outcome, ord)``: facts with status, rules with weight, refused reviews.

    A review of an unknown fact, of a fact of an unknown rule, or with an unknown outcome is refused.
    """
    known = facts.select(F.col("id").alias("fact_id"), "rule_id")
    have = rules.select(F.col("id").alias("rule_id"), F.lit(True).alias("_rule"))
    seen = reviews.join(known, "fact_id", "left").join(have, "rule_id", "left").withColumn(
        "error",
        F.when(F.col("rule_id").isNull(), "unknown fact").when(F.col("_rule").isNull(), "unknown rule")
        .when(~F.col("outcome").isin(OUTCOMES), "unknown outcome"),
    )
    good = seen.filter(F.col("error").isNull())
    last = keep_last(good.select("fact_id", "outcome", "ord"), ["fact_id"], ["ord"])
    status = last.select(F.col("fact_id").alias("id"), F.col("outcome").alias("review_status"))
    reviewed = facts.drop("review_status").join(status, "id", "left").withColumn(
        "review_status", F.coalesce("review_status", F.lit("pending"))
    )
    return reviewed, rule_weights(rules, good), seen.filter(F.col("error").isNotNull()).select("fact_id", "outcome", "error")


def usage_confidence(catalogue: DataFrame, usage: DataFrame) -> DataFrame:
    """Catalogue rows with the success share of all logged uses; unused ones keep their value."""
    rate = success_rate(usage, "skill", F.col("success")).select(F.col("skill").alias("name"), "rate")
    return (
        catalogue.join(rate, "name", "full_outer")
        .withColumn("confidence", F.coalesce("rate", "confidence")).drop("rate")
    )


def promote_fewshot(log: DataFrame, at_least: int = 3) -> DataFrame:
    """(repository, question, query text) of translations that were liked or succeeded often enough.

    ``log``: repository, question, dsl, outcome, liked, ord. The last qualifying text wins.
    """
    often = repeat_successes(log, at_least).select("repository", "question", F.lit(True).alias("_often"))
    rows = log.join(often, ["repository", "question"], "left")
    wins = rows.filter(
        F.coalesce("liked", F.lit(False)) | (F.coalesce("_often", F.lit(False)) & (F.col("outcome") == "succeeded"))
    )
    return keep_last(wins.select("repository", "question", "dsl", "ord"), ["repository", "question"], ["ord"]).drop("ord")


def schedules(graphs: DataFrame, config: DataFrame) -> DataFrame:
    """Every graph with its schedule, off and hourly by default; too short intervals are refused."""
    ok = config.filter(F.col("interval_minutes") >= MIN_INTERVAL)
    return graphs.join(ok, "graph_id", "left").withColumns(
        {
            "enabled": F.coalesce("enabled", F.lit(False)),
            "interval_minutes": F.coalesce("interval_minutes", F.lit(DEFAULT_INTERVAL)),
        }
    )


def due_graphs(plan: DataFrame, now) -> DataFrame:
    """Enabled graphs that never ran or whose interval has passed at ``now``."""
    passed = F.unix_timestamp(now) - F.unix_timestamp("last_run_at") >= F.col("interval_minutes") * 60
    return plan.filter("enabled").filter(F.col("last_run_at").isNull() | passed)


def number_messages(messages: DataFrame, order: list[str]) -> DataFrame:
    """Messages with their 0-based position in the session."""
    return number_rows(messages, ["graph_id", "session_id"], order, "seq", start=0)


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each session, oldest first."""
    last = top_k(messages, ["graph_id", "session_id"], [F.desc("seq"), F.desc("id")], n, "_r")
    return last.drop("_r").orderBy("graph_id", "session_id", "seq")
