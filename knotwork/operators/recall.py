"""Keyword, vector, hybrid and ranked recall."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from knotwork.functions.text import RECALL_STOPWORDS, contains_ci
from knotwork.functions.vectors import similarity_score
from knotwork.operators.loop import cut, keep_first
from knotwork.operators.nearest import cosine_of, nearest, unit
from knotwork.operators.ranking import top_k

LIMIT = 10
BM25_K1, BM25_B = 1.2, 0.75
MIN_CONFIDENCE, DOMAIN_BOOST = 0.5, 0.2


def _search_rows(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Both sources as (source, kind, id, text, seq); newer messages first, summaries by id."""
    m = messages.select(F.lit(1).alias("source"), F.lit("chat_message").alias("kind"), "id", F.col("content").alias("text"), "seq")
    s = summaries.filter(F.col("summary").isNotNull()).select(
        F.lit(2).alias("source"), F.lit("entity_summary").alias("kind"), "id", F.col("summary").alias("text"), F.lit(0).cast("bigint").alias("seq")
    )
    return m.unionByName(s)


def keyword_recall(messages: DataFrame, summaries: DataFrame, text: str, limit: int = LIMIT) -> DataFrame:
    """Messages then summaries that contain the text, each source cut to the limit."""
    hits = _search_rows(messages, summaries).filter(contains_ci("text", text))
    return top_k(hits, ["source"], [F.desc("seq"), F.asc("id")], limit, "pos").orderBy("source", "pos")


def vector_recall(queries: DataFrame, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query_id, id, score, rank): most similar items per query vector.

    ``queries``: graph_id, id, vector; ``items``: graph_id, id, vector.
    """
    q = unit(queries.withColumn("space", F.col("graph_id")), "vector")
    i = unit(items.withColumn("space", F.col("graph_id")), "vector")
    hits = nearest(q, i, limit)
    return hits.select(
        F.col("left_id").alias("query_id"), F.col("right_id").alias("id"),
        similarity_score(cosine_of(F.col("distance"))).alias("score"), "rank",
    )


def merge_hits(parts: list[DataFrame], limit: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Hits ``(id, pos, ...)`` of several sources in order, first one per id, cut to the limit; for each of ``keys``, if any."""
    rows, own = None, list(keys) or ["_all"]
    for n, part in enumerate(parts):
        part = part if keys else part.withColumn("_all", F.lit(0))
        part = part.select(*own, "id", "kind", F.lit(n).alias("part"), F.col("pos").cast("bigint").alias("pos"))
        rows = part if rows is None else rows.unionByName(part)
    first = keep_first(rows, [*own, "id"], ["part", "pos"])
    return top_k(first, own, [F.asc("part"), F.asc("pos"), F.asc("id")], limit, "rank").drop("_all")


def hybrid_by_query(messages, summaries, text: str, queries: DataFrame, entity_hits: DataFrame, message_hits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``hybrid_recall`` for every row of ``queries`` (query_id); the vector hits carry a query_id.

    The keyword hits, at most twice the limit, are the same for all of them.
    """
    words = keyword_recall(messages, summaries, text, limit)
    ordered = words.select("id", "kind", (F.col("source") * F.lit(limit) + F.col("pos")).alias("pos"), F.lit(0).alias("_k"))
    every = queries.select("query_id", F.lit(0).alias("_k")).join(ordered, "_k").drop("_k")
    parts = [every, entity_hits.withColumn("kind", F.lit("entity_summary")), message_hits.withColumn("kind", F.lit("chat_message"))]
    return merge_hits(parts, limit, ("query_id",))


def hybrid_recall(messages, summaries, text: str, entity_hits: DataFrame, message_hits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Keyword hits, then entity vector hits, then message vector hits."""
    words = keyword_recall(messages, summaries, text, limit)
    ordered = words.select("id", "kind", (F.col("source") * F.lit(limit) + F.col("pos")).alias("pos"))
    return merge_hits([ordered, entity_hits.withColumn("kind", F.lit("entity_summary")), message_hits.withColumn("kind", F.lit("chat_message"))], limit)


def recall_terms(question: Column) -> Column:
    """Array of the search terms of a question: its words of four letters or more that are no stop words, without
    marks around them; the whole question where none is left."""
    bare = F.transform(F.split(F.trim(question), r"\s+"), lambda w: F.btrim(w, F.lit("?.,!\"'")))
    telling = F.filter(bare, lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(*sorted(RECALL_STOPWORDS)))
    return F.when(F.size(telling) > 0, telling).otherwise(F.array(question))


def question_recall(messages: DataFrame, summaries: DataFrame, question: str, limit: int = LIMIT) -> DataFrame:
    """Hits of every term in term order, first one per id, with the share of terms that hit.

    All terms are looked for in one pass.
    """
    terms = recall_terms(F.lit(question))
    found = F.array_compact(F.transform(terms, lambda t, i: F.when(contains_ci("text", t), i)))
    rows = _search_rows(messages, summaries).withColumn("term", F.explode(found))
    each = top_k(rows, ["term", "source"], [F.desc("seq"), F.asc("id")], limit, "pos")
    per_term = top_k(each, ["term"], [F.asc("source"), F.asc("pos")], limit, "place")
    share = per_term.agg(F.count_distinct("term") / F.size(terms)).scalar()
    first = keep_first(per_term.select("id", "kind", "term", "place"), ["id"], ["term", "place"])
    cut_to = top_k(first.withColumn("_all", F.lit(0)), ["_all"], [F.asc("term"), F.asc("place")], limit, "rank").drop("_all")
    return cut_to.select("rank", "id", "kind").withColumn("confidence", share)


def recall_questions(messages: DataFrame, summaries: DataFrame, questions: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(graph_id, question_id, rank, id, kind, confidence) for a table of questions (graph_id, question_id, question).

    Messages and summaries carry a graph_id and are looked at by the questions of their graph alone. A graph's terms are
    gathered into one row, so each text is read once for all of them; limits hold per graph, question and term.
    Confidence is the share of a question's terms that hit. Questions with the same id in a graph must not differ.
    """
    asked = questions.select("graph_id", "question_id", recall_terms(F.col("question")).alias("terms"))
    terms = asked.select("graph_id", "question_id", F.posexplode("terms").alias("term", "t"), F.size("terms").alias("n"))
    per_graph = terms.groupBy("graph_id").agg(F.collect_list(F.struct("question_id", "term", "t", "n")).alias("terms"))
    m = messages.select("graph_id", F.lit(1).alias("source"), F.lit("chat_message").alias("kind"), "id", F.col("content").alias("text"), "seq")
    s = summaries.filter(F.col("summary").isNotNull()).select(
        "graph_id", F.lit(2).alias("source"), F.lit("entity_summary").alias("kind"), "id", F.col("summary").alias("text"), F.lit(0).cast("bigint").alias("seq")
    )
    low = F.lower("text")
    met = m.unionByName(s).join(per_graph, "graph_id").select(
        "graph_id", "source", "kind", "id", "seq", F.explode(F.filter("terms", lambda x: F.contains(low, F.lower(x["t"])))).alias("x")
    ).select("graph_id", "source", "kind", "id", "seq", F.col("x.question_id").alias("question_id"), F.col("x.term").alias("term"), F.col("x.n").alias("n"))
    own = ["graph_id", "question_id"]
    each = top_k(met, [*own, "term", "source"], [F.desc("seq"), F.asc("id")], limit, "pos")
    per_term = cut(top_k(each, [*own, "term"], [F.asc("source"), F.asc("pos")], limit, "place"))
    share = per_term.groupBy(*own).agg((F.count_distinct("term") / F.max("n")).alias("confidence"))
    first = keep_first(per_term.select(*own, "id", "kind", "term", "place"), [*own, "id"], ["term", "place"])
    ranked = top_k(first, own, [F.asc("term"), F.asc("place")], limit, "rank")
    return ranked.join(share, own).select(*own, "rank", "id", "kind", "confidence")


def overlap_ranking(catalogue: DataFrame, task: str, limit: int = 5) -> DataFrame:
    """Catalogue rows by shared words over the number of task words; rows without overlap are dropped."""
    tokens = lambda text: F.split(F.trim(F.lower(text)), r"\s+")
    sought = F.array_distinct(F.filter(tokens(F.lit(task)), lambda w: F.length(w) >= 3))
    described = F.transform(tokens(F.col("description")), lambda w: F.btrim(w, F.lit(".,()")))
    score = F.when(F.size(sought) > 0, F.size(F.array_intersect(described, sought)) / F.size(sought))
    hits = catalogue.select("name", score.alias("score")).filter(F.col("score") > 0)
    return top_k(hits.withColumn("_all", F.lit(0)), ["_all"], [F.desc("score"), F.asc("name")], limit).drop("_all")


def _occurrences(words: str, term: str):
    return F.size(F.filter(words, lambda x: x == term))


def ranked_search(catalogue: DataFrame, task: str, domain: str | None = None, limit: int = 5) -> DataFrame:
    """BM25 over descriptions of rows with confidence above one half or none; a domain match adds 0.2.

    ``catalogue``: name, description, confidence, domain. Term counts are taken in one pass, as the
    terms of a task are few; the driver reads one row with the collection figures.
    """
    terms = sorted(set(re.findall(r"[a-z0-9]+", task.lower())))
    if not terms:
        return catalogue.select("name", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("rank")).limit(0)
    words = F.regexp_extract_all(F.lower("description"), F.lit("([a-z0-9]+)"), 1)
    rows = catalogue.filter(F.col("confidence").isNull() | (F.col("confidence") > MIN_CONFIDENCE)).select("name", "domain", words.alias("w"))
    rows = rows.select("name", "domain", F.size("w").alias("length"), *[
        _occurrences("w", t).alias(f"t{i}") for i, t in enumerate(terms)
    ])
    rows = cut(rows)
    figures = rows.agg(
        F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))]
    ).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"t{i}"), figures[f"d{i}"]
        idf = math.log(1.0 + (figures["n"] - df + 0.5) / (df + 0.5))
        weight = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / (figures["mean"] or 1.0)))
        score = score + F.when(tf > 0, F.lit(idf) * weight).otherwise(0.0)
    hits = rows.select("name", "domain", score.alias("text_score")).filter(F.col("text_score") > 0)
    boost = F.when(F.col("domain") == domain, DOMAIN_BOOST).otherwise(0.0) if domain is not None else F.lit(0.0)
    hits = hits.select("name", (F.col("text_score") + boost).alias("score"))
    return top_k(hits.withColumn("_all", F.lit(0)), ["_all"], [F.desc("score"), F.asc("name")], limit).drop("_all")


def with_prerequisites(hits: DataFrame, requires: DataFrame) -> DataFrame:
    """Search hits with the sorted names they require; ``requires``: name, required."""
    lists = requires.join(hits.select("name"), "name", "left_semi").groupBy("name").agg(F.array_sort(F.collect_set("required")).alias("requires"))
    return hits.join(lists, "name", "left").withColumn("requires", F.coalesce("requires", F.array().cast("array<string>")))
