"""Registered queries against their SQL on the smallest data folder."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "S4_triples", "S7_load_ontology", "F9_manual_rows", "J1_pattern_single", "A3_noisy_or", "B1_upsert_edges", "W1_message_numbers",
    "R2_inference_trace", "G0_projection", "G5_closeness", "X5_materialization", "X9_ungrounded_claims", "E3_duplicate_candidates",
    "K6_ranked_search", "V4_grades", "Y1_streamed_edges", "F5_set_properties", "R11_saved_run", "G11_diameter", "K4_questions_by_graph", "X7_latest_summaries",
    "K3_hybrid_by_query", "G14_similar_pairs",
]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert got == rows(names, cur.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "label", "score"]
