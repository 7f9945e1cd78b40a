"""Paths on cyclic graphs with parallel edges, against brute force; helpers."""

import itertools

from graphloom.functions.porter import stem
from graphloom.functions.text import glob_regex, owner_rule_regex, read_only
from graphloom.model import Graph, clamp
from graphloom.operators.graph import mermaid
from graphloom.plans.paths import expand

EDGES = [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("c", "d", "USES"), ("a", "b", "USES"), ("d", "d", "CALLS")]


def brute(seed, hops, both=False):
    walk = [(s, d, i) for i, (s, d, _) in enumerate(EDGES)] + ([(d, s, i) for i, (s, d, _) in enumerate(EDGES) if s != d] if both else [])
    found, level = [], [((seed,), ())]
    for _ in range(hops):
        level = [((*ns, b), (*es, i)) for ns, es in level for a, b, i in walk if a == ns[-1] and i not in es]
        found += [" ".join(ns) for ns, _ in level]
    return sorted(found)


def graph(spark):
    nodes = spark.createDataFrame([(x, "Service", x) for x in "abcd"], "id string, label string, name string")
    return Graph(nodes, spark.createDataFrame([(*e, None) for e in EDGES], "src string, dst string, type string, confidence string"))


def test_paths_use_each_edge_once(spark):
    g = graph(spark)
    seeds = spark.createDataFrame([("a",), (None,), ("zz",)], "seed string")
    for direction, hops in itertools.product(("out", "both"), (1, 3, 5)):
        rows = expand(seeds, g.edges, hops, direction).collect()
        assert sorted(" ".join(r["nodes"]) for r in rows) == brute("a", hops, direction == "both")


def test_helpers():
    assert [clamp(x, 1, 10) for x in (0, 3.9, "x", float("nan"), 99)] == [1, 3, 1, 1, 10]
    assert glob_regex("src/*.ts") == "^src/[^/]*\\.ts$" and glob_regex("**/x?") == "^.*/x.$"
    import re

    assert re.match(owner_rule_regex("/docs/"), "docs/a/b.md") and not re.match(owner_rule_regex("/docs/"), "x/docs/a")
    assert re.match(owner_rule_regex("*.go"), "a/b/c.go") and not re.match(owner_rule_regex("*.go"), "a.go/x.ts")
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "agreed", "sky", "generalizations", "hope")] == ["caress", "poni", "relat", "hop", "agre", "sky", "gener", "hope"]
    assert read_only("SELECT 1")[0] is None and read_only("-- x\nWITH a AS (SELECT 1) SELECT * FROM a", 900) == (None, 500)
    assert read_only("DROP TABLE x")[0] and read_only("SELECT 1; SELECT 2")[0] and read_only("select * from t where a = 'set'")[0] and read_only(" ")[0]
    assert mermaid([("a", "b", "x\"y")]).splitlines()[0] == "sequenceDiagram"
