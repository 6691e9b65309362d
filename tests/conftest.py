import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from knotwork.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 4, "4g")


@pytest.fixture(scope="session")
def make(spark):
    def nodes(rows):
        """(id, type[, salience[, activation]]) with the id as label."""
        full = [(r[0], r[0], r[1], float(r[2]) if len(r) > 2 else 1.0, r[3] if len(r) > 3 else None) for r in rows]
        return spark.createDataFrame(full, "id string, label string, type string, salience double, activation double")

    def edges(rows):
        """(source, target[, type[, weight]]) with ids by position."""
        full = [
            (f"e{i + 1}", r[0], r[1], r[2] if len(r) > 2 else "R", float(r[3]) if len(r) > 3 else 1.0) for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(full, "id string, source string, target string, type string, weight double")

    def rules(rows):
        """(id, edge_type, source_type, target_type, threshold, weight)."""
        full = [(r[0], r[0], r[1], r[2], r[3], float(r[4]), float(r[5]), "{source} -> {target}", i) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            full, "id string, name string, edge_type string, source_type string, target_type string, threshold double, weight double, description string, ord int"
        )

    def ids(*names):
        return spark.createDataFrame([(n,) for n in names], "id string")

    return type("Make", (), {"nodes": staticmethod(nodes), "edges": staticmethod(edges), "rules": staticmethod(rules), "ids": staticmethod(ids)})


@pytest.fixture(scope="session")
def onto(spark):
    from knotwork.sources.ontology import Ontology

    classes = spark.createDataFrame(
        [("u:bank", "commercial bank", None), ("u:bank", "Commercial Bank", None), ("u:formal", "formal organization", None),
         ("u:org", "organization", None), ("u:sec", "security", None), ("u:reg", "regulator", None),
         ("u:ror", "rate of return", None), ("u:pct", "percentage", None), ("u:qv", "quantity value", None), ("u:date", "date", None), ("u:ti", "time instant", None)],
        "uri string, label string, comment string",
    )
    properties = spark.createDataFrame(
        [("p:issues", "issues", "u:org", "u:sec"), ("p:reg", "is regulated by", "u:org", "u:reg"), ("p:rep", "reports", None, None)],
        "uri string, label string, domain string, range string",
    )
    subclass = spark.createDataFrame(
        [("u:bank", "u:formal"), ("u:formal", "u:org"), ("u:ror", "u:pct"), ("u:pct", "u:qv"), ("u:date", "u:ti"), ("u:org", "u:formal")],
        "child_uri string, parent_uri string",
    )
    return Ontology(classes, properties, subclass)


def values(df, key, value):
    return {r[key]: r[value] for r in df.collect()}
