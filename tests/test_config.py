"""Configuration files with indentation: entries, workflows, services and the folders they are built from."""

from pyspark.sql import functions as F

from sparkloom.sources import config as m

FLOW = """# pipeline
name: "Build & Test"   # shown
on:
  push:
    branches: [main]
  pull_request:

jobs:
  test:
    name: Unit
    runs-on: 'ubuntu-22.04'
    strategy:
      matrix:
        node: [18, 20]
    steps:
    - uses: actions/checkout@v4
    - name: Setup
      uses: actions/setup-node@v4
      with:
        node-version: 20
    - run: |
        npm ci
        - not a step

        npm test
    - shell: bash
  deploy:
    needs: [test, "lint"]
    steps:
      - name: Release
        run: npm run deploy  # now
  lint:
    needs:
      - test
"""
COMPOSE = """version: "3"
services:
  web:
    build: ./web/
    ports:
      - "8080:80"
      - 443:443/tcp
      - 9000
    depends_on: [db]
  api:
    build:
      context: services/api
      dockerfile: D
    depends_on:
      db:
        condition: ok
      web:
  db:
    image: postgres:16 # tag
volumes:
  data:
"""


def table(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def test_entries(spark):
    text = "a: 1\nb:\n  - x\n  - k: v\n    l: 'w # no'\n  -\n    m: n\nc: >-\n  one: two\n\n  three\nd: [1, 2] # c\n\te: \"f: g\"\nhttp://x: y\nplain words\n"
    rows = spark.range(1).select(m.entries(F.lit(text)).alias("e")).first().e
    assert [(list(r.path), r.name, r.value, r.line) for r in rows] == [
        ([], "a", "1", 1), ([], "b", "", 2), (["b", "#3"], "", "x", 3), (["b", "#4"], "k", "v", 4), (["b", "#4"], "l", "w # no", 5), (["b", "#6"], "", "", 6), (["b", "#6"], "m", "n", 7),
        ([], "c", "one: two\nthree", 8), ([], "d", "[1, 2]", 12), (["d"], "e", "f: g", 13),
    ]
    assert spark.range(1).select(m.entries(F.lit("")).alias("e")).first().e == []


def test_workflows(spark):
    files = table(spark, {".github/workflows/ci.yml": FLOW, ".github/workflows/sub/no.yml": FLOW, "x.yml": FLOW, ".github/workflows/tiny.YAML": "on: push\n", ".github/workflows/list.yml": "on: [push, 'tag']\njobs:\n  a:\n    steps: []\n", ".github/workflows/items.yml": "on:\n  - push\n  - push\n"})
    got = {(r.file.split("/")[-1], r.job): r for r in m.workflows(files).collect()}
    assert set(got) == {("ci.yml", "test"), ("ci.yml", "deploy"), ("ci.yml", "lint"), ("tiny.YAML", None), ("list.yml", "a"), ("items.yml", None)}
    test, deploy, lint = (got["ci.yml", j] for j in ("test", "deploy", "lint"))
    assert (test.name, test.triggers, test.job_name, test.runs_on, test.needs) == ("Build & Test", ["push", "pull_request"], "Unit", "ubuntu-22.04", [])
    assert [tuple(s) for s in test.steps] == [("actions/checkout@v4", "actions/checkout@v4", None), ("Setup", "actions/setup-node@v4", None), ("npm ci\n- not a step\nnpm test", None, "npm ci\n- not a step\nnpm test"), ("Step", None, None)]
    assert (deploy.needs, deploy.runs_on, [tuple(s) for s in deploy.steps]) == (["test", "lint"], "ubuntu-latest", [("Release", None, "npm run deploy")]) and lint.needs == ["test"] and lint.steps == []
    assert (got["tiny.YAML", None].name, got["tiny.YAML", None].triggers) == ("tiny", ["push"]) and got["list.yml", "a"].triggers == ["push", "tag"] and got["items.yml", None].triggers == ["push"]
    lines = {r.file: r.lines for r in m.workflow_lines(m.workflows(files)).collect()}
    assert lines[".github/workflows/ci.yml"] == "Build & Test (on push, pull_request)\n  Unit on ubuntu-22.04: 4 steps\n  deploy on ubuntu-latest after test, lint: 1 step\n  lint on ubuntu-latest after test: 0 steps"
    assert lines[".github/workflows/tiny.YAML"] == "tiny (on push)" and m.workflows(files.limit(0)).count() == 0


def test_services(spark):
    files = table(spark, {"compose.yaml": COMPOSE, "docker-compose.yml": COMPOSE.replace("web", "front"), "a/docker-compose.yml": COMPOSE})
    got = {r.name: r for r in m.compose(files).collect()}
    assert set(got) == {"front", "api", "db"} and {r.file for r in got.values()} == {"docker-compose.yml"}
    got = {r.name: r for r in m.compose(table(spark, {"compose.yaml": COMPOSE})).collect()}
    assert (got["web"].build, got["web"].ports, got["web"].depends) == ("./web/", ["8080:80", "443:443"], ["db"])
    assert (got["api"].build, got["api"].ports, got["api"].depends, got["db"].image) == ("services/api", [], ["db", "web"], "postgres:16")
    folders = spark.createDataFrame([("web",), ("web",), ("api",), ("services/api",)], "path string")
    linked = m.service_folders(m.compose(table(spark, {"compose.yaml": COMPOSE})), folders)
    assert {(r.name, r.folder) for r in linked.collect()} == {("web", "web"), ("api", "services/api")}
    assert m.compose(files.limit(0)).count() == 0 == m.compose(table(spark, {"compose.yml": "services:\n"})).count()
