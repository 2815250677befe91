"""Graph operators against plain Python on random graphs, and on the fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.plans import views as V


def frames(spark, nodes, edges):
    n = spark.createDataFrame([(x, f"f{x}", "d", 1, 10, x % 5 == 4, x == 0) for x in nodes], "node long, name string, folder string, complexity long, loc long, is_test boolean, is_entry boolean")
    return n, spark.createDataFrame(edges, "src long, dst long")


def reachable(nodes, edges):
    out = {n: set() for n in nodes}
    for a, b in edges:
        out[a].add(b)
    seen = {}
    for n in nodes:
        found, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in found:
                found.add(x)
                todo += out[x]
        seen[n] = found
    return seen


@pytest.fixture(scope="module")
def sample():
    rnd = random.Random(4)
    nodes = list(range(24))
    edges = sorted({(rnd.randrange(24), rnd.randrange(24)) for _ in range(34)} - {(k, k) for k in nodes})
    return nodes, edges


def test_components_and_blast(spark, sample):
    nodes, edges = sample
    reach = reachable(nodes, edges)
    comp = {n: min([n, *(m for m in reach[n] if n in reach[m])]) for n in nodes}
    assert {r.node: r.component for r in G.components(*frames(spark, nodes, edges)).collect()} == comp
    want = {n: sum(n in reach[m] and comp[m] != comp[n] for m in nodes) for n in nodes}
    assert {r.node: r.blast for r in G.blast(*frames(spark, nodes, edges)).collect()} == want


def test_betweenness(spark, sample):
    nodes, edges = sample
    out = {n: sorted(b for a, b in edges if a == n) for n in nodes}
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, order, before = {s: 0}, {s: 1.0}, [s], {n: [] for n in nodes}
        for v in order:
            for w in out[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    top = max(total.values())
    got = {r.node: r.between for r in G.betweenness(*frames(spark, nodes, edges)).collect()}
    assert all(abs(got[n] - total[n] / top) < 1e-9 for n in nodes)


def test_no_edges(spark):
    nodes, edges = frames(spark, range(3), [])
    assert {r.component for r in G.components(nodes, edges).collect()} == {0, 1, 2}
    assert [r.blast for r in G.blast(nodes, edges).collect()] == [0, 0, 0]
    assert G.cycles(nodes, edges).count() == 0 and {r.between for r in G.betweenness(nodes, edges).collect()} == {0.0}


def test_small_repository(spark):
    """Files 1 and 2 are imported by an entry, 2 by three more; 4 is a test of 1."""
    nodes, edges = frames(spark, range(7), [(0, 1), (0, 2), (1, 2), (3, 2), (5, 2), (4, 1)])
    facts = {r.node: r for r in G.degrees(nodes, edges).collect()}
    assert facts[2].fan_in == 4 and facts[0].fan_out == 2
    assert [r.node for r in G.hubs(G.degrees(nodes, edges)).orderBy(F.desc("fan_in")).collect()] == [2, 1]
    assert {r.node for r in G.orphans(G.degrees(nodes, edges)).collect()} == {3, 5, 6}
    assert {r.node for r in V.tested(nodes, edges).collect()} == {1, 2}
    blast = {r.node: r.blast for r in G.blast(*frames(spark, range(3), [(0, 1), (1, 2)])).collect()}
    assert blast == {0: 0, 1: 1, 2: 2}


def test_communities(spark):
    edges = [("r", a, b) for g in (0, 10) for a in range(g, g + 4) for b in range(g, g + 4) if a != b] + [("r", 3, 10)]
    got = {r.node: r.community for r in G.communities(spark.createDataFrame(edges, "repo string, src long, dst long")).collect()}
    assert not {got[k] for k in range(4)} & {got[k] for k in range(10, 14)} and len(set(got.values())) < len(got)


def test_clean_repository_scores_higher(spark):
    nodes, edges = frames(spark, [0, 1, 2], [(0, 1), (1, 2)])
    clean = V.score(nodes, edges).first()
    risky = V.score(nodes.withColumn("complexity", F.lit(30)), edges.union(edges.select("dst", "src"))).first()
    assert clean.score >= 80 and clean.score > risky.score and risky.cycles == 1


def test_resolve_takes_the_first(spark):
    imports = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "src long, spec string")
    files = spark.createDataFrame([("lib/a.js",), ("lib/a.ts",), ("lib/b/index.js",)], "path string")
    assert {r.spec: r.path for r in V.resolve(imports, F.col("spec"), files, ("", ".js", ".ts", "/index.js")).collect()} == {"a": "lib/a.js", "b": "lib/b/index.js", "c": None}


def test_layers_of_a_long_chain(spark):
    nodes, edges = frames(spark, range(70), [(k, k + 1) for k in range(69)] + [(0, 50)])
    assert {r.node: r.layer for r in G.layers(nodes, edges).collect()} == {k: k for k in range(70)}


@pytest.mark.parametrize("edges", [[(0, 1), (1, 2), (2, 1)], [(0, 1), (1, 1)]])
def test_layers_refuse_cycles(spark, monkeypatch, edges):
    monkeypatch.setattr(G, "LOOK_FOR_CYCLES", 4)
    with pytest.raises(ValueError):
        G.layers(*frames(spark, range(3), edges))
