"""Ontology tables read from RDF triples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from knotwork.functions.text import local_name

# Names of the OWL, RDF and RDFS vocabularies.
OWL_CLASS = "http://www.w3.org/2002/07/owl#Class"
OWL_PROPERTIES = [
    "http://www.w3.org/2002/07/owl#ObjectProperty",
    "http://www.w3.org/2002/07/owl#DatatypeProperty",
]
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"


@dataclass(frozen=True)
class Ontology:
    classes: DataFrame      # uri, label, comment
    properties: DataFrame   # uri, label, domain, range
    subclass: DataFrame     # child_uri, parent_uri


def load_schema(triples: DataFrame) -> Ontology:
    """Classes, properties and direct subclass pairs of (s, p, o) triples; blank nodes are left out."""

    def values(predicate: str, name: str) -> DataFrame:
        return triples.filter(F.col("p") == RDFS + predicate).select(F.col("s").alias("uri"), F.col("o").alias(name))

    def iri(column):
        return ~F.col(column).startswith("_:")

    typed = triples.filter((F.col("p") == RDF_TYPE) & iri("s"))
    label = F.coalesce("label", local_name("uri")).alias("label")
    classes = (
        typed.filter(F.col("o") == OWL_CLASS).select(F.col("s").alias("uri")).distinct()
        .join(values("label", "label"), "uri", "left").join(values("comment", "comment"), "uri", "left")
        .select("uri", label, "comment").distinct()
    )
    properties = (
        typed.filter(F.col("o").isin(OWL_PROPERTIES)).select(F.col("s").alias("uri")).distinct()
        .join(values("label", "label"), "uri", "left").join(values("domain", "domain"), "uri", "left")
        .join(values("range", "range"), "uri", "left").select("uri", label, "domain", "range").distinct()
    )
    subclass = (
        triples.filter((F.col("p") == RDFS + "subClassOf") & iri("s") & iri("o"))
        .select(F.col("s").alias("child_uri"), F.col("o").alias("parent_uri")).distinct()
    )
    return Ontology(classes, properties, subclass)
