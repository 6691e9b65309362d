"""Searches in blocks, bounds on distances, and graphs with hubs, against brute-force versions."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from knotwork.operators import centrality, components, loop, paths, reasoning, searches, typing
from conftest import values


def brute(n, arcs):
    """Hop distances of all pairs that are connected along ``arcs``."""
    out = {}
    near = collections.defaultdict(set)
    for a, b in arcs:
        near[a].add(b)
    for s in range(n):
        seen, front, depth = {s: 0}, [s], 0
        while front:
            depth += 1
            front = [y for x in front for y in near[x] if y not in seen and not seen.update({y: depth})]
        out |= {(s, t): d for t, d in seen.items()}
    return out


def connected(rng, n, reach, extra):
    arcs = {(rng.randrange(max(0, i - reach), i), i) for i in range(1, n)}
    return sorted(arcs | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(extra)})


@pytest.fixture(scope="module")
def star(make):
    """A hub with half of all edges in a graph of 60 nodes."""
    rng = random.Random(8)
    arcs = [("hub", f"n{i:02d}") for i in range(40)] + [(f"n{i:02d}", "hub") for i in range(0, 40, 4)]
    arcs += [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(50)]
    arcs = sorted({a for a in arcs if a[0] != a[1]})
    return make.nodes([("hub", "T")] + [(f"n{i:02d}", "T" if i % 2 else "U") for i in range(60)]), make.edges([(a, b, "R", 0.5 + (i % 7) / 10) for i, (a, b) in enumerate(arcs)])


def test_hub_is_dealt_into_parts(spark):
    rows = [(0, i) for i in range(1000)] + [(i, 0) for i in range(1, 1000)]
    table = spark.createDataFrame(rows, "source bigint, target bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    split = searches.Links(table, most=50)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = {r["p"]: r["n"] for r in split.table.filter("source = 0").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    assert len(sizes) > 2 and max(sizes.values()) < 600
    assert split.table.filter("source = 0").groupBy("_part").count().agg(F.max("count")).first()[0] < 100
    front = spark.createDataFrame([(0, 5), (3, 7), (5000, 1)], "source bigint, v bigint")
    whole = searches.Links(table)
    assert not whole.split and split.split
    assert sorted(split.meet(front).collect()) == sorted(whole.meet(front).collect())
    assert sorted(split.meet(front, "left").select("source", "target", "v").collect(), key=str) == sorted(whole.meet(front, "left").select("source", "target", "v").collect(), key=str)


def test_passes_grow_with_what_they_reach(make, monkeypatch):
    """Pairs reach one node each, so a pass of 4000 rows holds more blocks than if each block reached all nodes."""
    nodes = make.nodes([(f"{side}{i:04}", "T") for i in range(2000) for side in "ab"])
    edges = make.edges([(f"a{i:04}", f"b{i:04}") for i in range(2000)])
    found, plain = [], centrality.search
    monkeypatch.setattr(centrality, "search", lambda links, part: found.append(part.count()) or plain(links, part))
    got = {r["id"]: (r["reached"], r["hops"], r["far"]) for r in centrality.hop_profile(nodes, edges, rows=4000).collect()}
    assert got == {f"{side}{i:04}": ((1, 0, 0), (2, 1, 1))[side == "b"] for i in range(2000) for side in "ab"}
    assert len(found) <= 4 and sum(found) == 4000, found


def test_dense_searches_go_by_numbers_within_the_links(spark, make, monkeypatch):
    """The arcs of a component are numbers before they are made distinct, and partitions do not widen a pass."""
    nodes, edges = make.nodes([(f"n{i}", "T") for i in range(20)]), make.edges([(f"n{i}", f"n{i + 1}") for i in range(19)] + [("n3", "n3")])
    _, arcs, _ = paths._component_graph(nodes, edges)
    assert dict(arcs.dtypes) == {"source": "bigint", "target": "bigint"} and arcs.count() == 38
    links = searches.Links(arcs)
    monkeypatch.setattr(searches, "ROWS", 1)
    monkeypatch.setattr(searches, "DENSE", 2)
    assert searches.room_within(links) == 19
    links.drop()
    row = paths.hop_metrics(nodes, edges).first()
    assert (row["diameter"], row["other_components"]) == (19.0, 0) and abs(row["average_path_length"] - 7) < 1e-9


def test_hot_key_of_a_join(spark):
    big = spark.range(500).select(F.col("id"), F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"))
    small = spark.createDataFrame([(1, "a"), (450, "b")], "k bigint, v string")
    want = sorted(tuple(r) for r in big.join(small, "k", "inner").select("id", "k", "v").collect())
    got = searches.join_hot(big, small, "k", 500, "inner", most=20).select("id", "k", "v")
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 401
    assert searches.join_hot(big, small, "k", 500, "left", most=20).count() == 500


def test_results_do_not_depend_on_hubs(star, make):
    nodes, edges = star
    for run in (
        lambda most: values(centrality.pagerank(nodes, edges, tol=1e-3, most=most).select("id", F.round("score", 9).alias("s")), "id", "s"),
        lambda most: {r["id"]: tuple(r) for r in centrality.hop_profile(nodes, edges, most=most).collect()},
        lambda most: {r["id"]: tuple(r) for r in components.min_labels(edges.filter("id > 'e3'"), nodes, most).collect()},
        lambda most: {r["id"]: tuple(r) for r in paths.distances(edges, make.ids("n03"), most).collect()},
        lambda most: paths.find_path(nodes, edges, "n03", "n39", most).first(),
        lambda most: values(reasoning.spread(reasoning.spread_links(nodes, edges, most), make.ids("hub").withColumn("activation", F.lit(1.0)))[0], "id", "activation"),
        lambda most: {r["id"]: tuple(r) for r in typing.majority_vote(nodes, edges, nodes.filter("id > 'n1' OR id = 'hub'").select("id", F.col("type").alias("label")), most).collect()},
    ):
        assert run(3) == run(searches.PART)


@pytest.mark.parametrize("n,reach,extra", [(1, 1, 0), (12, 1, 0), (70, 12, 4)])
def test_bounds_settle_distances(spark, n, reach, extra):
    rng = random.Random(n)
    arcs = connected(rng, n, reach, extra) if n > 1 else []
    both = [*arcs, *[(b, a) for a, b in arcs]]
    hops = brute(n, both)
    far = {s: max(d for (a, _), d in hops.items() if a == s) for s in range(n)}
    links = searches.Links(spark.createDataFrame(both, "source bigint, target bigint").distinct(), most=20)
    ids = spark.range(n)
    found, used = searches.eccentricities(ids, links, pick=4, rounds=2)
    assert {r["id"]: (r["low"], r["high"]) for r in found.collect()} == {s: (d, d) for s, d in far.items()} and used <= n + 32
    found, few = searches.eccentricities(ids, links, True, pick=8, rounds=2)
    assert found.agg(F.max("low")).first()[0] == max(far.values())
    if n == 70:
        assert few < n / 2
    found, every = searches.eccentricities(ids, links, rounds=0, rows=1)
    assert {r["id"]: r["low"] for r in found.collect()} == far and every == n


def test_profile_in_several_passes(spark):
    rng = random.Random(9)
    n = 1300  # three blocks of sources
    arcs = connected(rng, n, 700, 300)
    name = "node-{:04d}".format
    hops = brute(n, arcs)
    nodes = spark.createDataFrame([(name(i),) for i in range(n)], "id string")
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in arcs], "source string, target string")
    want = {name(t): [0, 0, 0] for t in range(n)}
    for (_, t), d in hops.items():
        row = want[name(t)]
        row[0], row[1], row[2] = row[0] + 1, row[1] + d, max(row[2], d)
    got = centrality.hop_profile(nodes, edges, rows=1)
    assert {r["id"]: [r["reached"], r["hops"], r["far"]] for r in got.collect()} == want


def test_pairs_in_several_stretches(star):
    nodes, edges = star
    def rows(df):
        return sorted((r["src"], r["id"], round(r["distance"], 9)) for r in df.collect())

    whole = rows(paths.all_pairs_distances(nodes, edges))
    assert rows(paths.all_pairs_distances(nodes, edges, rows=200)) == whole
    some = nodes.filter("id < 'n05'")
    assert rows(paths.all_pairs_distances(nodes, edges, some, rows=70)) == [r for r in whole if r[0] < "n05"]
    assert paths.all_pairs_distances(nodes.limit(0), edges.limit(0)).count() == 0
    assert values(centrality.betweenness(nodes, edges, rows=100), "id", "score") == pytest.approx(values(centrality.betweenness(nodes, edges), "id", "score"))


def test_checkpoints_of_rounds_go(spark, star):
    import os

    nodes, edges = star

    def size():
        top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        return sum(os.path.isdir(os.path.join(top, d)) for d in os.listdir(top))

    loop.cut(nodes)
    before = size()
    centrality.pagerank(nodes, edges, tol=1e-4).count()
    assert size() <= before + 4  # some ten rounds


def test_changes_find_what_whole_rounds_find(make):
    """The loop by changes against rounds over all pairs from the start."""
    rng = random.Random(12)
    nodes = make.nodes([(f"n{i:02d}", "T" if i % 3 else "U") for i in range(30)])
    edges = make.edges([(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}", rng.choice("RS"), 0.8) for _ in range(90)])
    rules = make.rules([("r", "R", "T", "T", 0.3, 0.9), ("q", "R", "T", "T", 0.5, 0.7), ("s", "S", "T", "U", 0.2, 1.0), ("z", "S", "U", "T", 0.0, 0.5)])
    source = make.ids("n01")
    out = reasoning.reason(nodes, edges, rules, source, decay=0.7, most=4)
    links, evals = reasoning.spread_links(nodes, edges), reasoning.evaluations(nodes, edges, rules)
    activation, facts = None, None
    for i in range(1, out.iterations + 1):
        act, _ = reasoning.spread(links, reasoning.seed_source(activation, source), 0.7)
        new, _ = reasoning.infer(evals, act, facts, i)
        activation = loop.cut(reasoning.feed_back(act, new))
        facts = new if facts is None else loop.cut(facts.unionByName(new))
    def flat(df):
        return sorted((r["id"], round(r["confidence"], 9), r["iteration"], len(r["proof_path"])) for r in df.collect())

    assert flat(out.facts) == flat(facts) and out.iterations > 2 and out.converged_by == "fixpoint"
    rounded = lambda df: {r["id"]: round(r["activation"], 9) for r in df.collect()}
    assert rounded(out.activation) == rounded(activation)
    assert out.trace.filter("fired").count() == facts.select(F.explode("contributing_fact_ids")).count()
