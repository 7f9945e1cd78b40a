"""Service edges: lists, long lists and blocks against brute force; pairs stay out of shuffles."""

from collections import Counter

import pytest

from graphloom.model import Graph
from graphloom.operators import graph as g

# a1 calls every API, p0 is exposed by all; b-services share sets of topics, some several members
EDGES = (
    [("a1", f"p{i}", "CALLS_API") for i in range(12)] + [(f"a{k}", f"p{(k * i) % 12}", "CALLS_API") for k in range(2, 6) for i in range(3)]
    + [(f"b{k}", f"p{i}", "EXPOSES") for k in range(9) for i in range(12) if i == 0 or (k * i) % 4 == 1] + [("a2", "p1", "EXPOSES")]
    + [(f"b{k}", f"t{i}", "PRODUCES") for k in range(9) for i in range(5) if i <= k % 3] + [(f"a{k}", f"t{i}", "CONSUMES") for k in range(11) for i in range(5) if i >= k % 4] + [("b1", "t0", "CONSUMES")]
)


def brute():
    of = lambda kind: [(s, d) for s, d, t in EDGES if t == kind]
    n = Counter((a, b, "CALLS_API") for a, x in of("CALLS_API") for b, y in of("EXPOSES") if x == y)
    for a, x in set(of("PRODUCES")):
        for b, y in set(of("CONSUMES")):
            if x == y:
                n[a, b, "PRODUCES"] += 1
                n[b, a, "CONSUMES"] += 1
    return sorted((*k, v) for k, v in n.items() if k[0] != k[1])


def edges(spark):
    nodes = spark.createDataFrame([], "id string, label string, name string")
    return g.service_edges(Graph(nodes, spark.createDataFrame([(*e, None) for e in EDGES], "src string, dst string, type string, confidence string")))


@pytest.mark.parametrize("limit", [1_000, 3])
def test_service_edges_match_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(g, "LIST", limit)
    monkeypatch.setattr(g, "BLOCK", 2)
    assert sorted(tuple(r) for r in edges(spark).select("from_id", "to_id", "kind", "n").collect()) == brute()


def test_pairs_are_not_shuffled(spark):
    plan = edges(spark)._jdf.queryExecution().optimizedPlan().toString()
    pairs = [line for line in plan.splitlines() if "Aggregate [from_id" in line and "to_id" in line.split("]")[0]]
    assert all("SHARED_TABLE" in line for line in pairs)
