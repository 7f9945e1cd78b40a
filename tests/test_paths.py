"""Walks take only the frontier's edges while it is narrow, and give the same paths when it is wide."""

import pytest
from test_graph import EDGES, brute, graph

from graphloom.plans import paths


@pytest.mark.parametrize("near", [100_000, 1, 0])
def test_narrow_and_wide_frontiers_agree(spark, monkeypatch, near):
    monkeypatch.setattr(paths, "NEAR", near)
    g, seeds = graph(spark), spark.createDataFrame([("a",), (None,)], "seed string")
    for direction in ("out", "both"):
        rows = paths.expand(seeds, g.edges, 3, direction).collect()
        assert sorted(" ".join(r["nodes"]) for r in rows) == brute("a", 3, direction == "both")
    some = g.nodes.where("id <> 'd'")
    assert sorted(" ".join(r["nodes"]) for r in paths.expand(seeds, g.edges, 3, allowed=some).collect()) == [p for p in brute("a", 3) if "d" not in p]
    assert {r["node"] for r in paths.reachable(seeds, g.edges, 2).collect()} == {p.split()[-1] for h in (1, 2) for p in brute("a", h)}


def test_only_edges_near_the_frontier_are_written(spark, monkeypatch):
    many = spark.range(5_000).selectExpr("concat('x', id) as src", "concat('y', id) as dst", "'CALLS' as type", "cast(null as string) as confidence")
    few, rows = spark.createDataFrame([(*e, None) for e in EDGES], many.schema), []

    def written(df, name):
        out = kept(df, name)
        rows.append(out.count())
        return out

    kept = paths.written
    monkeypatch.setattr(paths, "written", written)
    allowed = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert paths.expand(spark.createDataFrame([("a",)], "seed string"), many.unionByName(few), 3, allowed=allowed).count() == len(brute("a", 3))
    assert max(rows) < 100
