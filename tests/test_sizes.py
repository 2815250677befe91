"""Work that must not grow faster than the tables: rows dealt to all tasks, nothing quadratic inside a row."""

import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom import bindings as B
from sparkloom import code_tables as K
from sparkloom.operators import grammar
from sparkloom.operators import graph as G
from sparkloom.operators import history as H
from sparkloom.operators import symbols as S
from sparkloom.plans import docs as T
from sparkloom.plans import views as V
from sparkloom.queries import QUERIES, guides


@pytest.mark.parametrize("name", ["q_parse", "q_remove_clause"])
def test_rows_of_one_file_are_dealt(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= 4


def test_a_long_folder_doc_is_read_in_one_pass(spark):
    lines = [f"FILE: f{k % 3000}: text {k}" for k in range(6000)]
    start = time.monotonic()
    read = spark.createDataFrame([("FOLDER: all\n" + "\n".join(lines),)], "t string").select(T.parse_doc(F.col("t")).alias("d")).first().d
    assert time.monotonic() - start < 30
    assert [(f.name, f.text) for f in read.files] == [(f"f{k}", f"text {k + 3000}") for k in range(3000)]


def test_pairs_of_packages_are_not_compared(spark, sf_dir):
    plan = QUERIES["join_dir_fanout"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Aggregate" not in plan.split("Join")[0]


def _packages(spark, packages, imports, files):
    name = F.concat(F.lit("p"), (F.col("id") % packages).cast("string"))
    return spark.range(imports).select(F.concat(F.lit("s"), "id").alias("path"), name.alias("package")), spark.range(files).select(F.concat(name, F.lit("/"), F.col("id").cast("string")).alias("path"))


def test_pairs_of_packages_are_written_small(spark, tmp_path):
    S.package_targets(*_packages(spark, 25, 10_000, 5000)).write.parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 1_000_000  # half a byte for each of 2,000,000 pairs


def test_packages_are_cut_into_blocks(spark, monkeypatch):
    for name, size in (("LIST", 3), ("DOWN", 20), ("ACROSS", 11)):
        monkeypatch.setattr(S, name, size)
    imports, files = _packages(spark, 2, 50, 90)
    want = sorted((r.path, f.path) for r in imports.collect() for f in files.collect() if f.path.startswith(r.package + "/"))
    assert sorted(tuple(r) for r in S.package_targets(imports, files).collect()) == want
    assert S.package_targets(imports.where("package = 'none'"), files).isEmpty()


def test_imports_are_not_multiplied_by_their_candidates(spark, sf_dir):
    plan = QUERIES["join_import_resolve"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]


def test_generated_files_of_one_small_file_are_dealt(spark, sf_dir):
    assert B.code(spark, sf_dir).rdd.getNumPartitions() >= 4
    assert guides._texts(spark, sf_dir, "s{k}/compose.yml", guides.COMPOSE).rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("name", ["join_cooccur", "win_first_seen_cap"])
def test_pairs_are_dealt_before_they_are_counted(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [a" in plan


def test_links_of_few_folders_are_cut_by_shares_first(spark, sf_dir):
    plan = QUERIES["v_ai_folder_facts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [folder" in plan


def test_documents_are_dealt_before_they_are_measured(spark, sf_dir):
    plan = QUERIES["agg_tech_debt"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan


def test_a_filter_on_paths_does_not_read_one_file(spark, sf_dir):
    assert len(K.repository(spark, sf_dir).where("path = 'go.mod'").inputFiles()) >= 4


def test_hubs_are_listed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(G, "LIST", 5)
    pairs = sorted({(a, b) for k in range(40) for a, b in ((0, k + 1), (k + 1, 0), (k, k + 1))})
    edges = spark.createDataFrame(pairs, "src long, dst long")
    rows = G.listed(edges).collect()
    assert sorted((r.src, x) for r in rows for x in r.ends) == pairs
    assert sum(r.src == 0 for r in rows) > 1 and max(len(r.ends) for r in rows) < 20
    nodes = edges.select(F.col("src").alias("node")).distinct()
    rank = {r.node: r["rank"] for r in G.pagerank(nodes, edges).collect()}
    want, out = dict.fromkeys(range(41), 1 / 41), {n: sum(a == n for a, _ in pairs) for n in range(41)}
    for _ in range(24):
        want = {n: 0.15 / 41 + 0.85 * sum(want[a] / out[a] for a, b in pairs if b == n) for n in want}
    assert all(abs(rank[n] - want[n]) < 1e-9 for n in want)
    assert {r.depth for r in G.reach(nodes.where("node = 3").select(F.lit(1).alias("key"), "node"), edges).collect()} == {0, 1, 2}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_imports_are_read_and_dealt_once(spark, sf_dir):
    plan = _plan(QUERIES["agg_unresolved_top"](spark, sf_dir))
    assert plan.count("Relation [l_orderkey") == 1 and "RepartitionByExpression [name" in plan


def test_texts_are_resolved_from_the_files(spark):
    paths = ["lib/a", "lib/a.js", "lib/a.js.js", "lib/b.ts", "lib/b.ts", "lib/c/index.js", "lib/.js", "lib/", "other/d.js", "lib", None]
    asked = ["a", "a.js", "b", "c", "", "d", "b.ts", "li", None, "a"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = V.resolve(spark.createDataFrame(list(enumerate(asked)), "src int, spec string"), F.col("spec"), files, ("", ".js", ".ts", "/index.js")).collect()
    want = [next((f"lib/{a}{e}" for e in ("", ".js", ".ts", "/index.js") if a is not None and f"lib/{a}{e}" in paths), None) for a in asked]
    assert [r.path for r in sorted(got)] == want


def test_commits_are_dealt_before_they_are_distinct(spark, sf_dir):
    plan = _plan(B.commits(spark, sf_dir))
    assert "RepartitionByExpression [commit" in plan and plan.index("Aggregate [commit") < plan.index("RepartitionByExpression [commit")


def test_files_of_a_commit_meet_where_they_are_counted(spark):
    rows = [(1, p) for p in "cab"] + [(2, "a")] + [(3, "b"), (3, "a"), (3, "b")] + [(4, f"f{k}") for k in range(H.MAX_FILES + 1)]
    found = H.pairs(spark.createDataFrame(rows, "commit int, path string"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", "b"), (1, "a", "c"), (1, "b", "c"), (3, "a", "b")]
    assert "Join" not in _plan(found)


def test_statements_that_begin_with_keywords_are_not_tried_at_every_place():
    slow = [s.pattern for rules in grammar._COMPILED.values() for s, p in rules if p.pattern.startswith("(?<!") and s.pattern.startswith(("import ", "export ", "(?<=\\n )from ", "class "))]
    assert not slow
    found = grammar.statements("a.js", "javascript", "export class A {}\nimportant\nimport './b.js'; reexport class B {}")
    assert [(r["kind"], r["name"]) for r in found] == [("import", "./b.js"), ("export", "A"), ("class", "A"), ("class", "B")]


def test_rounds_move_lists_to_ranges_of_nodes(spark):
    pairs = [(f"n{a:03}", f"n{(a + d) % 200:03}") for a in range(200) for d in (1, 2, 3, 4)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([(f"n{a:03}",) for a in range(201)], "node string")
    named, steps, parts = G.ranges(nodes, edges)
    part, rows = {r.node: r.part for r in named.collect()}, steps.collect()
    assert len(part) == 201 and max(part.values()) < parts and list(dict(sorted(part.items())).values()) == sorted(part.values())
    assert sorted((r.src, x) for r in rows for x in r.ends) == sorted(pairs) and all(part[x] == r.part for r in rows for x in r.ends)
    assert len(rows) < len(pairs) / 2
    assert {round(r["rank"], 9) for r in G.pagerank(nodes, edges).where("node <> 'n200'").collect()} == {round(0.15 / 201 * sum(0.85**k for k in range(24)) + 0.85**24 / 201, 9)}


def _links(spark):
    dice = random.Random(5)
    links = [(repo, a, b) for repo, n in (("r", 60), ("s", 20)) for a in range(n // 2) for b in (dice.randrange(n) for _ in range(4))]
    return links, spark.createDataFrame(links + links[:9] + [(None, 1, 2)], "repo string, src long, dst long")


def test_communities_are_those_of_plain_half_passes(spark):
    links, edges = _links(spark)
    links = [(repo, a, b) for repo, a, b in links + links[:9] if a != b]
    seeds = [F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(2)).alias(str(k)) for k in range(8)]
    turn = {r.id: r for r in spark.range(60).select("id", *seeds).collect()}
    degree, twice = Counter((r, x) for r, a, b in links for x in (a, b)), Counter(r for r, a, b in links for _ in range(2))
    home, still = {n: n[1] for n in degree}, 0
    for half in range(16):
        total, weight = Counter(), defaultdict(Counter)
        for (r, n), c in home.items():
            total[r, c] += degree[r, n]
            weight[r, n][c] += 0
        for r, a, b in links:
            weight[r, a][home[r, b]] += 1
        new = {}
        for (r, n), near in weight.items():
            gain = lambda c: round(near[c] - degree[r, n] * (total[r, c] - (degree[r, n] if c == home[r, n] else 0)) / twice[r], 9)  # noqa: B023, E731
            new[r, n] = min((-gain(c), c != home[r, n], c) for c in near)[2] if turn[n][str(half // 2)] == half % 2 else home[r, n]  # noqa: B023
        still, home = still + 1 if new == home else 0, new
        if still == 2:
            break
    assert {(r.repo, r.node): r.community for r in G.communities(edges).collect()} == home


def test_edges_to_nodes_that_stay_are_dealt_once(spark, monkeypatch):
    plans, stage = [], G.stage
    monkeypatch.setattr(G, "stage", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), stage(df, name))[1])
    G.communities(_links(spark)[1])
    rounds = [plan for name, plan in plans if name == "communities"][1:]
    assert rounds and all(plan.count("InMemoryRelation") >= 3 for plan in rounds)
    # what waits and what is told meet without another exchange
    assert all(not re.search(r"Exchange hashpartitioning\(node#\w+, repo#\w+, near#", plan) for plan in rounds)
    assert not spark.sparkContext._jsc.getPersistentRDDs().size()
