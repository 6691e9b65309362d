import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import values
from knotwork.operators import centrality, community, components, facts, paths, projection, similarity, typing
from knotwork.operators.registry import run_algorithm


def test_degree_and_empty(make):
    nodes, edges = make.nodes([(n, "T") for n in "habc"]), make.edges([("h", "a"), ("h", "b"), ("h", "c")])
    got = values(run_algorithm(nodes, edges), "id", "score")
    assert got["h"] == 1.0 and all(0 <= v <= 1 for v in got.values())
    assert run_algorithm(nodes.limit(0), edges).count() == 0 and run_algorithm(nodes, edges, "none").count() == 0
    with pytest.raises(projection.EmptyGraphError):
        projection.project(edges, nodes.limit(0))


def test_inward_star(make):
    nodes, edges = make.nodes([(n, "T") for n in "habc"]), make.edges([("a", "h"), ("b", "h"), ("c", "h")])
    rank = values(centrality.pagerank(nodes, edges), "id", "score")
    assert max(rank, key=rank.get) == "h" and abs(sum(rank.values()) - 1) < 1e-6
    close = values(centrality.closeness(nodes, edges), "id", "score")
    assert close == {"h": 1.0, "a": 0.0, "b": 0.0, "c": 0.0}


def brute(names, links):
    out = {n: sorted({t for s, t in links if s == n and t != n}) for n in names}
    dist, sigma = {}, {}
    for s in names:
        d, sg, level = {s: 0}, {s: 1.0}, [s]
        while level:
            nxt = {}
            for v in level:
                for w in out[v]:
                    if w not in d:
                        nxt[w] = nxt.get(w, 0.0) + sg[v]
            for w, c in nxt.items():
                d[w], sg[w] = d[level[0]] + 1, c
            level = list(nxt)
        dist[s], sigma[s] = d, sg
    between = dict.fromkeys(names, 0.0)
    for s, t in itertools.permutations(names, 2):
        if t in dist[s]:
            for v in names:
                if v not in (s, t) and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                    between[v] += sigma[s][v] * sigma[v][t] / sigma[s][t]
    n = len(names)
    between = {k: v / ((n - 1) * (n - 2)) for k, v in between.items()}
    close = {}
    for v in names:
        ds = [dist[s][v] for s in names if v in dist[s] and s != v]
        close[v] = len(ds) / sum(ds) * len(ds) / (n - 1) if ds else 0.0
    return between, close


def test_betweenness_and_closeness_brute(make):
    rnd = random.Random(5)
    names = [f"n{i:02d}" for i in range(14)]
    links = [(rnd.choice(names), rnd.choice(names)) for _ in range(34)]
    between, close = brute(names, links)
    nodes, edges = make.nodes([(n, "T") for n in names]), make.edges(links)
    for rows in (None, 2):
        got = values(centrality.betweenness(nodes, edges, rows), "id", "score")
        assert all(abs(got[k] - between[k]) < 1e-9 for k in names)
    got = values(centrality.closeness(nodes, edges), "id", "score")
    assert all(abs(got[k] - close[k]) < 1e-9 for k in names)


def test_hops_beyond_one_block(make):
    names = [f"n{i:04d}" for i in range(700)]
    nodes, edges = make.nodes([(n, "T") for n in names]), make.edges([(n, "n0000") for n in names[1:]])
    row = {r["id"]: r for r in centrality.hop_profile(nodes, edges).collect()}
    assert row["n0000"]["reached"] == 700 and row["n0000"]["hops"] == 699 and row["n0699"]["reached"] == 1


def test_weighted_diamond(make):
    nodes = make.nodes([(n, "T") for n in "abcd"])
    edges = make.edges([("a", "b", "R", 1), ("b", "d", "R", 1), ("a", "d", "R", 10), ("a", "c", "R", 1)])
    got = paths.weighted_shortest_path(nodes, edges, "a", "d").collect()
    assert got[0]["path"] == ["a", "b", "d"] and got[0]["cost"] == 2
    assert paths.weighted_shortest_path(nodes, edges, "c", "d").count() == 0
    assert paths.weighted_shortest_path(nodes, edges, "a", "zz").count() == 0
    pairs = {(r["src"], r["id"]): r["distance"] for r in paths.all_pairs_distances(nodes, edges).collect()}
    assert pairs[("a", "d")] == 2 and pairs[("c", "c")] == 0 and ("c", "d") not in pairs


def test_zero_weights_do_not_circle(make):
    nodes, edges = make.nodes([(n, "T") for n in "abz"]), make.edges([("z", "b", "R", 1), ("b", "a", "R", 0), ("a", "b", "R", 0)])
    assert paths.weighted_shortest_path(nodes, edges, "z", "a").first()["path"] == ["z", "b", "a"]


def test_path_graph_metrics(make):
    nodes, edges = make.nodes([(n, "T") for n in "abcd"]), make.edges([("a", "b"), ("c", "b"), ("c", "d")])
    row = paths.hop_metrics(nodes, edges).first()
    assert row["diameter"] == 3 and row["other_components"] == 0 and abs(row["average_path_length"] - 10 / 6) < 1e-9
    more, links = make.nodes([(n, "T") for n in "abcdxy"]), make.edges([("a", "b"), ("c", "b"), ("c", "d"), ("x", "y")])
    assert paths.hop_metrics(more, links).first()["other_components"] == 1
    assert values(paths.eccentricity(more, links), "id", "eccentricity") == {"a": 3, "b": 2, "c": 2, "d": 3}


def test_find_path(make):
    nodes, edges = make.nodes([(n, "T") for n in ("Acme", "Bank", "Zurich", "Lone")]), make.edges([("Acme", "Bank", "owns"), ("Zurich", "Bank", "hosts")])
    row = paths.find_path(nodes, edges, "acme", "ZURICH").first()
    assert row["found"] and row["proof"] == "Acme →[owns]→ Bank →[hosts]→ Zurich"
    assert "No path" in paths.find_path(nodes, edges, "Acme", "Lone").first()["error"]
    assert "not found" in paths.find_path(nodes, edges, "Nobody", "Lone").first()["error"]
    assert paths.find_path(nodes, edges, " ", "Lone").first()["error"] == paths.LABELS_REQUIRED
    assert paths.find_path(nodes, edges, "Lone", "lone").first()["path"] == ["Lone"]


def test_shared_neighbours(make, spark):
    nodes, edges = make.nodes([(n, "T") for n in "abcxyz"]), make.edges([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "z")])
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "u string, v string")
    got = values(similarity.jaccard_pairs(edges, pairs), "v", "score")
    assert abs(got["b"] - 2 / 3) < 1e-9 and got["c"] == 0
    assert values(similarity.adamic_adar(edges, pairs), "v", "score")["b"] > 0
    with pytest.raises(ValueError):
        similarity.similar_pairs(edges, 0)


def test_similar_pairs_meet_in_stretches(make, monkeypatch):
    """No stretch meets many more pairs than it may, and numbers give the pairs that names did."""
    rnd, met, plain = random.Random(8), [], similarity.Links.meet
    links = [(f"c{i}", f"p{rnd.randrange(12)}") for i in range(40) for _ in range(rnd.randrange(1, 7))]
    monkeypatch.setattr(similarity.Links, "meet", lambda *a: met.append(0) or plain(*a))
    whole = set(map(tuple, similarity.similar_pairs(make.edges(links), 0.4).collect()))
    assert len(met) == 1
    parts = set(map(tuple, similarity.similar_pairs(make.edges(links), 0.4, rows=50).collect()))
    assert len(met) > 4 and parts == whole
    sets = {}
    for s, t in links:
        sets.setdefault(s, set()).add(t)
        sets.setdefault(t, set()).add(s)
    assert {(u, v) for u, v, _ in whole} == {(u, v) for u in sets for v in sets if u < v and len(sets[u] & sets[v]) >= 0.4 * len(sets[u] | sets[v])}


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8])
def test_similar_pairs_brute(make, threshold):
    rnd = random.Random(11)
    links = [(f"n{rnd.randint(0, 18)}", f"n{int(18 * rnd.random() ** 2)}") for _ in range(90)] + [("n3", "n3")]
    near = {}
    for s, t in links:
        near.setdefault(s, set()).add(t)
        near.setdefault(t, set()).add(s)
    want = {}
    for u, v in itertools.combinations(sorted(near), 2):
        score = len((near[u] & near[v]) - {u, v}) / len(near[u] | near[v])
        if score >= threshold:
            want[(u, v)] = score
    got = {(r["u"], r["v"]): r["score"] for r in similarity.similar_pairs(make.edges(links), threshold).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_majority_vote(make, spark):
    nodes, edges = make.nodes([(n, "T") for n in "uabcz"]), make.edges([("u", "a"), ("b", "u"), ("u", "c")])
    labels = spark.createDataFrame([("a", "organization"), ("b", "organization"), ("c", "person")], "id string, label string")
    got = {r["id"]: (r["predicted_type"], r["confidence"]) for r in typing.majority_vote(nodes, edges, labels).collect()}
    assert got["u"] == ("organization", 2 / 3) and got["z"] == ("unknown", 0.0) and got["a"] == ("organization", 1.0)


def triangles(make, flip=False):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x")]
    return make.nodes([(n, "T") for n in "abcxyz"]), make.edges([(t, s) if flip else (s, t) for s, t in links])


def test_components_and_louvain(make):
    for flip in (False, True):
        nodes, edges = triangles(make, flip)
        assert values(components.weak_components(nodes, edges), "id", "component") == {"a": 0, "b": 0, "c": 0, "x": 1, "y": 1, "z": 1}
        got = values(community.louvain(nodes, edges), "id", "community")
        assert got == {"a": 0, "b": 0, "c": 0, "x": 1, "y": 1, "z": 1}


def test_louvain_modularity(make):
    rnd = random.Random(2)
    groups = [[f"g{g}n{i}" for i in range(8)] for g in range(4)]
    links = [(u, v) for g in groups for u, v in itertools.combinations(g, 2) if rnd.random() < 0.8]
    links += [(rnd.choice(rnd.choice(groups)), rnd.choice(rnd.choice(groups))) for _ in range(6)]
    nodes, edges = make.nodes([(n, "T") for g in groups for n in g]), make.edges(links)
    found = community.louvain(nodes, edges)
    assert found.count() == 32
    assert community.modularity(community.undirected(edges), found) > 0.55


def test_components_contract_and_hashes_are_unique(spark, make, monkeypatch):
    rnd, sizes, plain, seeds = random.Random(4), [], components.stored_counting, []
    links = [(f"n{rnd.randrange(300)}", f"n{rnd.randrange(300)}") for _ in range(1500)] + [("x1", "x2"), ("x2", "x0")]
    nodes, edges = make.nodes([(f"n{i}", "T") for i in range(300)] + [("alone", "T")]), make.edges(links)

    def counting(df, **metrics):
        done, seen = plain(df, **metrics)
        sizes.append(seen["n"])
        return done, seen

    def clashing(column, seed):
        seeds.append(seed)
        return F.lit(7).cast("bigint") if seed == 0 else F.xxhash64(F.lit(seed), F.col(column))

    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for s, t in links:
        a, b = sorted((find(s), find(t)))
        parent[b] = a
    want = {r["id"]: find(r["id"]) for r in nodes.collect()} | {v: find(v) for v in ("x0", "x1", "x2")}
    monkeypatch.setattr(components, "stored_counting", counting)
    assert values(components.min_labels(edges, nodes), "id", "component") == want
    assert sum(sizes[1:]) < sizes[0] / 2, sizes
    monkeypatch.setattr(components, "_hash", clashing)
    assert values(components.min_labels(edges, nodes), "id", "component") == want and max(seeds) == 1


def test_long_chain_components(make):
    names = [f"n{i:03d}" for i in range(200)]
    order = names[:]
    random.Random(1).shuffle(order)
    got = components.weak_components(make.nodes([(n, "T") for n in names]), make.edges(list(zip(order, order[1:]))))
    assert got.select("component").distinct().count() == 1 and got.count() == 200


def fact_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, source_id string, target_id string")


def test_cycles_and_impact(spark):
    ring = fact_rows(spark, [("f1", "a", "b"), ("f2", "b", "c"), ("f3", "c", "a"), ("f4", "c", "d"), ("f5", "d", "d"), ("f6", "e", "a")])
    assert {r["id"] for r in facts.circular_facts(ring).collect()} == {"f1", "f2", "f3", "f5"}
    line = fact_rows(spark, [("f1", "a", "b"), ("f2", "b", "c"), ("f3", "c", "d"), ("f9", "x", "y")])
    assert facts.circular_facts(line).count() == 0
    got = facts.fact_impact(line, spark.createDataFrame([("f1",)], "id string"))
    assert values(got, "fact_id", "depth") == {"f2": 1, "f3": 2}
    assert facts.fact_impact(line, spark.createDataFrame([("none",)], "id string")).count() == 0


def test_cycles_brute(spark):
    rnd = random.Random(9)
    for _ in range(3):
        rows = {(f"n{rnd.randint(0, 11)}", f"n{rnd.randint(0, 11)}") for _ in range(18)}
        reach = {s: {t for a, t in rows if a == s} for s in {x for r in rows for x in r}}
        for _ in range(12):
            for s in reach:
                reach[s] |= {y for t in list(reach[s]) for y in reach[t]}
        want = {f"{s}>{t}" for s, t in rows if s in reach[t] or s == t}
        got = facts.circular_facts(fact_rows(spark, [(f"{s}>{t}", s, t) for s, t in rows]))
        assert {r["id"] for r in got.collect()} == want


def test_rule_coverage(spark, make):
    rules = make.rules([(r, "R", "T", "T", 0.1, 1.0) for r in ("r1", "r2", "r3")])
    fired = spark.createDataFrame([("r1",), ("r1",), ("r1",), ("r2",), ("ghost",)], "rule_id string")
    got = {r["rule_id"]: (r["fires"], r["never_fired"], r["under_activated"]) for r in facts.rule_coverage(rules, fired).collect()}
    assert got == {"r1": (3, False, False), "r2": (1, False, True), "r3": (0, True, False)}


def test_variables_that_differ_in_case_only(spark):
    from knotwork.operators import pattern

    rows = [("a", "p", "b"), ("b", "p", "b"), ("b", "q", "c"), ("c", "q", "a")]
    triples = spark.createDataFrame([(*r, False, 1.0, i) for i, r in enumerate(rows)], "subject string, predicate string, object string, derived boolean, confidence double, ord bigint")
    atoms, _ = pattern.read_atoms("p(X, x), q(x, Y)")
    got = sorted((r["subject"], r["object"]) for r in pattern.query_join(triples, atoms).collect())
    assert got == [("a", "b"), ("b", "b")]
    atoms, _ = pattern.read_atoms("p(X, Y), q(Y, x), q(x, X)")
    assert [(r["subject"], r["object"]) for r in pattern.query_join(triples, atoms).collect()] == [("a", "b")]


def test_writing_one_graph_keeps_the_others(spark, tmp_path):
    from knotwork.sources.sinks import write_table

    def table(graph, *ids):
        return spark.createDataFrame([(graph, i) for i in ids], "graph_id string, id string")

    path = str(tmp_path / "nodes")
    write_table(table("g1", "a", "b").union(table("g2", "c")), path)
    write_table(table("g1", "z"), path)
    assert sorted((r["graph_id"], r["id"]) for r in spark.read.parquet(path).collect()) == [("g1", "z"), ("g2", "c")]


def test_rules_keep_their_order_over_files(spark, tmp_path):
    import json

    from knotwork.sources.graph import load_rules, merge_rules

    rule = lambda i: {"id": f"r{i}", "name": "n", "edge_type": "E", "source_type": "A", "target_type": "B", "threshold": 0.1}
    for part in range(3):
        (tmp_path / f"{part}.json").write_text(json.dumps([rule(10 * part + i) for i in (2, 1, 0)]))
    rules = load_rules(spark, str(tmp_path))
    got = [r["id"] for r in rules.orderBy("ord").collect()]
    assert got == [f"r{10 * part + i}" for part in range(3) for i in (2, 1, 0)]
    assert merge_rules(rules, rules.filter("id = 'r11'")).count() == 9


def test_pagerank_says_when_it_does_not_rest(make):
    import pytest as pt

    from knotwork.operators import centrality

    nodes, edges = make.nodes([("a", "T"), ("b", "T"), ("c", "T")]), make.edges([("a", "b"), ("b", "c"), ("c", "b")])
    with pt.raises(centrality.NotConvergedError):
        centrality.pagerank(nodes, edges, max_rounds=1)


def test_shared_neighbours_in_chunks(make, monkeypatch):
    """Lists cut into chunks, with loops: the pair itself is no common neighbour, but counts in the union."""
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("a", "x"), ("b", "x"), ("a", "y"), ("b", "y"), ("b", "z"), ("c", "z")]
    edges, pairs = make.edges(rows), make.edges([("a", "b"), ("a", "c"), ("b", "c")]).selectExpr("source AS u", "target AS v")
    near = {}
    for s, t in rows:
        near.setdefault(s, set()).add(t)
        near.setdefault(t, set()).add(s)
    common = {(u, v): (near[u] & near[v]) - {u, v} for u, v in (("a", "b"), ("a", "c"), ("b", "c"))}
    for chunk in (1, 2, 1 << 20):
        monkeypatch.setattr(similarity, "CHUNK", chunk)
        assert {(r["u"], r["v"]): r["shared"] for r in similarity.shared_neighbours(edges, pairs).collect()} == {k: len(w) for k, w in common.items() if w}
        got = {(r["u"], r["v"]): r["score"] for r in similarity.jaccard_pairs(edges, pairs).collect()}
        assert got == {(u, v): len(common[u, v]) / len(near[u] | near[v]) for u, v in common}
