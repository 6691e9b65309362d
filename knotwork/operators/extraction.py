"""Extraction payloads: vocabulary per text, validation, materialisation, claims, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from knotwork.functions.text import tokens
from knotwork.operators.filters import _known_flag
from knotwork.operators.loop import cut, folder, keep_first, stored
from knotwork.operators.ranking import number_rows, top_k
from knotwork.operators.searches import join_few
from knotwork.schema import EXTRACTION, HEURISTIC
from knotwork.sources.ontology import Ontology

PROMPT_CLASSES, PROMPT_PROPERTIES = 60, 40
INLINABLE = ["value", "temporal", "metadata"]
#: Settings under which reading a payload takes nothing that is not JSON.
STRICT = {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
# The heuristic types an implicit fact may have.
HEURISTIC_TYPES = [
    "presupposition", "conversational_implicature", "factual_impact", "image_schema", "metonymic_coercion",
    "moral_value_coercion", "symbolic_coercion", "event_sequence", "causal_relation", "implied_future_event",
    "implied_non_event",
]


def vocabulary_ranking(texts: DataFrame, labels: DataFrame, limit: int = PROMPT_CLASSES) -> DataFrame:
    """(doc_id, label, overlap, rank): the labels that share most tokens with each text.

    Labels without overlap fill up in label order. Texts meet labels through their tokens, so only
    labels with overlap are joined; the filling needs just the first ``limit`` labels of all, as at
    most that many can be missing.
    """
    vocabulary = labels.select("label").distinct()
    words = vocabulary.select("label", F.explode(tokens("label")).alias("token"))
    hits = (
        texts.select("doc_id", F.explode(tokens("text")).alias("token")).join(words, "token")
        .groupBy("doc_id", "label").agg(F.count("*").alias("overlap"))
    )
    best = top_k(hits, ["doc_id"], [F.desc("overlap"), F.asc("label")], limit)
    got = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "overlap"))).alias("got"))
    head = top_k(vocabulary.withColumn("_all", F.lit(0)), ["_all"], [F.asc("label")], limit, "_r")
    spare = head.agg(F.array_sort(F.collect_list("label"))).scalar()
    full = texts.select("doc_id").join(got, "doc_id", "left").select(
        "doc_id", F.coalesce("got", F.array().cast("array<struct<rank:bigint,label:string,overlap:bigint>>")).alias("got"), spare.alias("spare")
    )
    zero = F.lit(0).cast("bigint")
    filler = F.transform(F.array_except("spare", F.col("got.label")), lambda x: F.struct(zero.alias("rank"), x.alias("label"), zero.alias("overlap")))
    chosen = F.slice(F.concat("got", filler), 1, limit)
    return full.select("doc_id", F.posexplode(chosen).alias("pos", "v")).select(
        "doc_id", F.col("v.label").alias("label"), F.col("v.overlap").alias("overlap"), (F.col("pos") + 1).cast("bigint").alias("rank")
    )


def validate(payloads: DataFrame, onto: Ontology) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relationships and rejects of JSON payloads ``(doc_id, payload)``.

    Entities need a name and a known type; relationships a known relation and two names extracted
    from the same document, in any case; they take the extracted spelling. Confidence is 1 if absent.
    """
    read = payloads.select("doc_id", F.col("payload").alias("head"), F.from_json("payload", f"{EXTRACTION[:-1]},_corrupt:string>", STRICT).alias("p"))
    # A payload that was read to its end is JSON; only the others are parsed again, to tell broken ones from those of other types.
    doubtful = F.col("p").isNull() | F.col("p._corrupt").isNotNull()
    read = read.withColumn("bad", F.when(doubtful, F.try_parse_json("head").isNull()).otherwise(F.lit(False)))
    # Only the text of a broken payload is needed again.
    parsed = stored(read.select("doc_id", F.when(F.col("bad"), F.col("head")).alias("head"), "bad", F.col("p").dropFields("_corrupt").alias("p")))
    bad = parsed.filter("bad").select("doc_id", F.concat(F.lit("Could not parse response as JSON: "), "head").alias("reason"))
    good = parsed.filter(~F.col("bad"))

    def text(field):
        return F.trim(F.coalesce(F.col(field), F.lit("")))

    rows = good.select("doc_id", F.posexplode("p.entities").alias("pos", "e")).select(
        "doc_id", "pos", text("e.name").alias("name"), text("e.type").alias("type"),
        F.coalesce(F.expr("try_cast(e.confidence as double)"), F.lit(1.0)).alias("confidence"),
    )
    rows = stored(_known_flag(rows, "type", onto.classes, "known"))
    missing = (F.col("name") == "") | (F.col("type") == "")
    entities = rows.filter(~missing & F.col("known")).drop("known")
    bad_entities = rows.filter(missing | ~F.col("known")).select("doc_id", F.when(missing, F.concat(F.lit("Entity missing name/type: "), "name")).otherwise(
        F.concat(F.lit("Entity '"), "name", F.lit("' has unknown ontology type '"), "type", F.lit("'"))).alias("reason"))
    names = keep_first(entities.select("doc_id", F.lower("name").alias("key"), "name", "pos"), ["doc_id", "key"], ["pos"]).drop("pos")
    links = good.select("doc_id", F.posexplode("p.relationships").alias("pos", "r")).select(
        "doc_id", "pos", text("r.source").alias("source"), text("r.relation").alias("relation"), text("r.target").alias("target"),
        F.coalesce(F.expr("try_cast(r.confidence as double)"), F.lit(1.0)).alias("confidence"),
    )
    links = _known_flag(links, "relation", onto.properties, "known")
    # Merged: Spark takes what was read from compressed files for small enough to broadcast.
    for side in ("source", "target"):
        spell = names.select("doc_id", F.col("key").alias(f"_{side}"), F.col("name").alias(f"{side}_name")).hint("merge")
        links = links.withColumn(f"_{side}", F.lower(side)).join(spell, ["doc_id", f"_{side}"], "left").drop(f"_{side}")
    links = stored(links)
    both = F.col("source_name").isNotNull() & F.col("target_name").isNotNull()
    relationships = links.filter(F.col("known") & both).select(
        "doc_id", "pos", F.col("source_name").alias("source"), "relation", F.col("target_name").alias("target"), "confidence"
    )
    bad_links = links.filter(~F.col("known") | ~both).select("doc_id", F.when(
        ~F.col("known"), F.concat(F.lit("Relationship has unknown relation type '"), "relation", F.lit("'"))).otherwise(
        F.concat(F.lit("Relationship '"), F.concat_ws(" ", "source", "relation", "target"), F.lit("' references an unextracted entity"))).alias("reason"))
    return entities, relationships, bad.unionByName(bad_entities).unionByName(bad_links)


def plan_materialization(entities: DataFrame, relationships: DataFrame, roles: DataFrame) -> DataFrame:
    """Per (doc_id, name): node, or property of the one other entity it is related to, and why.

    Value, temporal and metadata entities with exactly one relation, not to themselves, become a
    property. ``roles``: type, role.
    """
    ends = relationships.select(
        "doc_id", F.explode(F.array(
            F.struct(F.col("source").alias("name"), F.col("target").alias("other"), "relation"),
            F.struct(F.col("target").alias("name"), F.col("source").alias("other"), "relation"),
        )).alias("x")
    ).select("doc_id", "x.*")
    per = ends.groupBy("doc_id", "name").agg(F.count("*").alias("fanout"), F.min(F.struct("other", "relation")).alias("only"))
    one = keep_first(entities.select("doc_id", "name", "type", "pos"), ["doc_id", "name"], [(-F.col("pos")).alias("_p")]).drop("pos")
    rows = join_few(one, roles, "type").join(per.hint("merge"), ["doc_id", "name"], "left").withColumn("fanout", F.coalesce("fanout", F.lit(0)))
    inline = F.coalesce(F.col("role").isin(INLINABLE) & (F.col("fanout") == 1) & (F.col("only.other") != F.col("name")), F.lit(False))
    reason = F.when(inline, F.concat(F.lit("role="), "role", F.lit(", fanout=1, inlined via '"), F.col("only.relation"), F.lit("'"))).when(
        F.col("role").isNull(), F.lit("no role resolved")).otherwise(F.concat(F.lit("role="), "role", F.lit(", fanout="), F.col("fanout").cast("string")))
    return rows.select(
        "doc_id", "name", F.when(inline, "property").otherwise("node").alias("policy"),
        F.when(inline, F.col("only.other")).alias("attach_to"), F.when(inline, F.col("only.relation")).alias("property_key"), reason.alias("reason"),
    )


def extract_with(texts: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Payloads ``(doc_id, payload)`` from a caller's function that maps a batch of texts to JSON texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "payload": model(list(pdf["text"]))})

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id bigint, payload string")


def extract_by_dictionary(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Payloads with the dictionary names ``(name, type)`` that occur as whole tokens in each text.

    Token runs of each length in use are joined to the names, so no text is tried against every name.
    """
    words = F.regexp_extract_all(F.lower("name"), F.lit("([a-z0-9]+)"), 1)
    names = cut(dictionary.select("name", "type", F.concat_ws(" ", words).alias("key"), F.size(words).cast("int").alias("n")).filter("n > 0"))
    lengths = names.agg(F.array_sort(F.collect_set("n"))).scalar()
    found = texts.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1).alias("w"), lengths.alias("ns"))
    found = found.select("doc_id", "w", F.explode("ns").alias("n")).filter(F.size("w") >= F.col("n"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))
    found = found.select("doc_id", F.explode(F.array_distinct(grams)).alias("key"))
    hits = found.join(names, "key").select("doc_id", F.struct("name", "type", F.lit(1.0).alias("confidence")).alias("e")).distinct()
    lists = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("entities"))
    return texts.select("doc_id").join(lists, "doc_id", "left").select(
        "doc_id", F.to_json(F.struct(F.coalesce("entities", F.array().cast("array<struct<name:string,type:string,confidence:double>>")).alias("entities"),
                                     F.array().cast("array<string>").alias("relationships"))).alias("payload")
    )


def validate_heuristics(payloads: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Implicit facts and rejects of payloads ``(graph_id, heuristic_type, payload, doc_id)``.

    A fact needs a text and at least one anchor that exists in the graph; confidence is 0.5 if absent.
    """
    parsed = payloads.withColumns({"bad": F.try_parse_json("payload").isNull(), "p": F.from_json("payload", HEURISTIC)})
    known = F.col("heuristic_type").isin(HEURISTIC_TYPES)
    wrong = parsed.filter(~known).select("doc_id", F.concat(F.lit("Unknown heuristic type '"), "heuristic_type", F.lit("'")).alias("reason"))
    bad = parsed.filter(known & F.col("bad")).select("doc_id", F.lit("Could not parse response as JSON").alias("reason"))
    rows = parsed.filter(known & ~F.col("bad")).select("graph_id", "heuristic_type", "doc_id", F.posexplode("p.facts").alias("pos", "f")).select(
        "graph_id", "heuristic_type", "doc_id", "pos", F.trim(F.coalesce(F.col("f.text"), F.lit(""))).alias("text"),
        F.transform("f.anchors", lambda a: F.trim(a)).alias("anchors"), F.coalesce(F.expr("try_cast(f.confidence as double)"), F.lit(0.5)).alias("confidence"),
    )
    ids = entities.select("graph_id", F.col("id").alias("anchor"))
    hits = rows.select("graph_id", "heuristic_type", "doc_id", "pos", F.posexplode("anchors").alias("at", "anchor")).join(ids, ["graph_id", "anchor"], "left_semi")
    lists = hits.groupBy("heuristic_type", "doc_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "anchor"))), lambda x: x["anchor"]).alias("anchor_entity_ids"))
    joined = rows.join(lists, ["heuristic_type", "doc_id", "pos"], "left")
    ok = (F.col("text") != "") & F.col("anchor_entity_ids").isNotNull()
    facts = joined.filter(ok).select("graph_id", "heuristic_type", "doc_id", "pos", "text", "confidence", "anchor_entity_ids", F.lit("pending").alias("status"))
    dropped = joined.filter(~ok).select("doc_id", F.when(F.col("text") == "", F.lit("Fact missing text")).otherwise(F.lit("Fact has no anchors in this graph")).alias("reason"))
    return facts, wrong.unionByName(bad).unionByName(dropped)


def ungrounded_claims(replies: DataFrame) -> DataFrame:
    """Sentences of ``reply`` with a capitalised phrase or a number that ``grounding`` does not hold.

    ``replies``: id, reply, grounding. The first letter of a sentence does not count as capital.
    """
    sentences = F.filter(F.transform(F.split("reply", r"(?U)(?<=[.!?])\s+"), lambda s: F.btrim(s, F.lit(" \t\n\r"))), lambda s: s != "")
    rows = replies.select("id", F.lower("grounding").alias("g"), F.posexplode(sentences).alias("pos", "sentence"))
    adjusted = F.concat(F.lower(F.substring("sentence", 1, 1)), F.substr("sentence", F.lit(2)))
    # The patterns of phrases and numbers that count as claims.
    phrases = F.regexp_extract_all(adjusted, F.lit(r"(?U)(\b[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)+\b)"), 1)
    numbers = F.regexp_extract_all(adjusted, F.lit(r"(?U)(\b\d[\d,.]{2,}\b)"), 1)
    novel = F.exists(F.concat(phrases, numbers), lambda t: ~F.contains("g", F.lower(t)))
    return rows.filter(novel).select("id", F.col("pos").cast("bigint").alias("pos"), "sentence")


def context_blocks(contexts: DataFrame, n: int = 20) -> DataFrame:
    """(entity_id, block, context): all contexts ``(entity_id, ord, text)`` of an entity, oldest first, n to a block."""
    placed = number_rows(contexts, ["entity_id"], ["ord", "text"], "_pos", start=0)
    rows = F.array_sort(F.collect_list(F.struct("_pos", "text")))
    return placed.groupBy("entity_id", F.expr(f"_pos div {n}").alias("block")).agg(
        F.array_join(F.transform(rows, lambda x: x["text"]), " ").alias("context")
    )


def summarise_with(contexts: DataFrame, existing: DataFrame, model: Callable[[str, str], str], n: int = 20) -> DataFrame:
    """New summary per entity: a caller's function of the summary so far and the next n contexts, until all are in.

    A round folds one block of the entities that have so many, and touches no others. Each round's summaries are written
    under its number; the result reads the last one of each entity.
    """
    blocks = cut(context_blocks(contexts, n))
    sizes = blocks.groupBy("entity_id").agg(F.max("block").alias("last"))
    rounds = blocks.agg(F.coalesce(F.max("block"), F.lit(-1)).alias("b")).first()["b"] + 1
    schema = "entity_id string, summary string"

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"entity_id": pdf["entity_id"], "summary": [model(o or "", c).strip() for o, c in zip(pdf["summary"], pdf["context"])]})

    path, state = folder(blocks.sparkSession), existing.select("entity_id", "summary")
    if not rounds:
        return blocks.select("entity_id", F.lit("").alias("summary"))
    for b in range(rounds):
        step = blocks.filter(F.col("block") == b).select("entity_id", "context").join(state, "entity_id", "left")
        step.mapInPandas(run, schema).write.mode("overwrite").parquet(f"{path}/block={b}")
        state = blocks.sparkSession.read.schema(schema).parquet(f"{path}/block={b}")
    every = blocks.sparkSession.read.schema(schema + ", block bigint").parquet(path)
    return every.join(sizes, "entity_id").filter(F.col("block") == F.col("last")).select("entity_id", "summary")


def prompt_vocabulary(texts: DataFrame, classes: DataFrame, properties: DataFrame, n_classes: int = PROMPT_CLASSES, n_properties: int = PROMPT_PROPERTIES) -> DataFrame:
    """(doc_id, kind, label, overlap, rank): the classes and the properties that a prompt names, each by a limit of its own."""
    ranked = [
        vocabulary_ranking(texts, labels, limit).withColumn("kind", F.lit(kind))
        for kind, labels, limit in (("class", classes, n_classes), ("property", properties, n_properties))
    ]
    return ranked[0].unionByName(ranked[1])
