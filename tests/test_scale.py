"""What grows with the tables: shuffle files, partitions, carried columns, and vectors that are sent."""

import time

from pyspark.sql import functions as F

from knotwork.operators import nearest as near
from knotwork.operators.loop import RELEASE, cut, stored
from knotwork.operators.paths import find_path
from knotwork.operators.projection import project
from knotwork.operators.typing import majority_vote
from knotwork.plans import registry


def test_finished_steps_leave_no_shuffle_files(spark):
    disk, before = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark.conf.get(RELEASE)

    def files():
        time.sleep(1)
        return {f for f in disk.getAllFiles().mkString(" ").split() if f.endswith(".data") and "/shuffle_" in f}

    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    for write in (cut, stored):
        start = files()
        done = write(counts)
        assert files() <= start, write
        assert done.agg(F.sum("n")).first()[0] == counts.agg(F.sum("n")).first()[0] == 1000
    assert spark.conf.get(RELEASE) == before


def test_ranges_are_kept_as_parquet(spark):
    from knotwork.operators.ranking import ranged

    assert all(f.endswith(".parquet") for f in ranged(spark.range(50), [], ["id"]).inputFiles() or ["none"])


def test_validated_payloads_are_kept_as_parquet_and_merged(spark, onto):
    from knotwork.operators import extraction

    text = '{"entities":[{"name":"HDFC","type":"commercial bank"},{"name":"P","type":"security"}],"relationships":[{"source":"hdfc","relation":"issues","target":"P"}]}'
    entities, links, dropped = extraction.validate(spark.createDataFrame([(1, text), (2, "no JSON")], "doc_id bigint, payload string"), onto)
    for rows in (entities, links):
        assert rows.inputFiles() and all(f.endswith(".parquet") for f in rows.inputFiles())
    roles = spark.createDataFrame([], "type string, role string")
    plan = extraction.plan_materialization(entities, links, roles)
    assert "SortMergeJoin" in plan._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc_id"], r["name"]) for r in entities.collect()} == {(1, "HDFC"), (1, "P")}
    assert [(r["source"], r["target"]) for r in links.collect()] == [("HDFC", "P")]
    assert [r["reason"] for r in dropped.collect()] == ["Could not parse response as JSON: no JSON"]


def test_shuffles_start_with_partitions_for_the_rows(spark, monkeypatch):
    from knotwork.plans.tpch_graph import TpchGraph

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    monkeypatch.setattr(registry, "ROWS", 100)
    try:
        registry.fit_shuffles(TpchGraph(spark, "/root/testdata/sf0.001"))
        assert int(spark.conf.get(name)) >= 40
    finally:
        spark.conf.unset(name)


def test_merged_shuffles_do_not_grow_with_the_tables(spark, monkeypatch):
    from knotwork.plans.tpch_graph import TpchGraph

    names = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]
    monkeypatch.setattr(registry, "ROWS", 100)
    try:
        registry.fit_shuffles(TpchGraph(spark, "/root/testdata/sf0.001"))
        wide = spark.range(1 << 18).withColumn("x", F.concat(*[F.sha2(F.concat("id", F.lit(i)), 512) for i in range(4)]))
        assert wide.groupBy(F.xxhash64("id").alias("k")).agg(F.max("x").alias("x")).rdd.getNumPartitions() > 6
        assert spark.conf.get(names[2]) == registry.SCANNED
    finally:
        for name in names:
            spark.conf.unset(name)


def test_frequent_types_and_ranges_do_not_gather_in_one_task(spark, onto):
    from knotwork.operators import extraction, ontology, ranking
    from knotwork.operators.searches import join_few

    rows = cut(spark.range(4000).select(F.lit("Rate of Return").alias("type"), F.col("id").alias("doc_id"), F.lit("x").alias("name"), F.lit(0).alias("pos")))
    links = spark.createDataFrame([], "doc_id bigint, source string, target string, relation string")
    few = spark.createDataFrame([("Rate of Return", "value"), ("other", "none")], "type string, role string")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "32",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        plan = extraction.plan_materialization(rows, links, ontology.type_roles(rows.select("type"), ontology.label_closure(onto)))
        assert "hashpartitioning(type" not in plan._jdf.queryExecution().executedPlan().toString()
        assert {r["reason"] for r in plan.collect()} == {"role=value, fanout=0"}
        for most in (0, 2):
            found = join_few(rows, few, "type", most).withColumn("p", F.spark_partition_id())
            assert found.filter("role = 'value'").count() == 4000
            assert found.groupBy("p").count().agg(F.max("count")).first()[0] < 4000, most
        assert ranking.ranged(rows, ["type"], ["doc_id"]).select("_range").distinct().count() > 16
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_projection_carries_no_column_that_nothing_reads(make):
    rows = project(make.edges([("a", "b", "R", 1.0), ("a", "b", "S", 2.0), ("b", "c")]))
    plan = rows.select("source", "target")._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan, plan
    assert {(r["source"], r["target"], r["id"], r["type"], r["weight"]) for r in rows.collect()} == {("a", "b", "e2", "S", 2.0), ("b", "c", "e3", "R", 1.0)}


def test_vectors_meet_in_stretches_of_chunks(spark):
    rows = spark.createDataFrame([(f"v{i:03}", "s", [float(i * i % 97), float(i)]) for i in range(90)], "id string, space string, vec array<double>")
    hits = near.nearest(rows, rows, 3, same=True, chunk=2)
    assert "CoGroups" in hits._jdf.queryExecution().optimizedPlan().toString()
    points = {r["id"]: r["vec"] for r in rows.collect()}

    def first(v):
        far = sorted((round(((points[v][0] - p[0]) ** 2 + (points[v][1] - p[1]) ** 2) ** 0.5, 9), u) for u, p in points.items() if u != v)
        return [u for _, u in far[:3]]

    found = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["left_id"], []).append(r["right_id"])
    assert found == {v: first(v) for v in points}


def test_votes_count_parallel_edges_once(make):
    nodes = make.nodes([(v, "T") for v in "abcd"])
    edges = make.edges([("a", "d"), ("d", "a"), ("a", "d", "S"), ("b", "d"), ("c", "d")])
    labels = nodes.filter(F.col("id") != "d").select("id", F.when(F.col("id") == "a", "x").otherwise("y").alias("label"))
    row = majority_vote(nodes, edges, labels).filter("id = 'd'").first()
    assert (row["predicted_type"], round(row["confidence"], 6)) == ("y", round(2 / 3, 6))


def test_path_takes_least_edges_and_skips_unknown_nodes(make):
    nodes = make.nodes([(v, "T") for v in "abcd"])
    edges = make.edges([("a", "z"), ("z", "d"), ("c", "a", "P"), ("a", "b", "Q"), ("b", "d", "R"), ("d", "c", "S"), ("a", "b", "U")])
    row = find_path(nodes, edges, "A", "D").first()
    assert (row["path"], row["edge_types"]) == (["a", "b", "d"], ["Q", "R"]) and row["proof"] == "a →[Q]→ b →[R]→ d"
