"""Bounded variable-length paths.

Nodes of a path may repeat, an edge may not. Paths grow one hop at a time by an equi-join of the
frontier with the edges that leave it. Of up to NEAR nodes the ids are broadcast, and only their
edges are taken from the tables, before any shuffle of these; for a wider frontier the edges of the
wanted types are written once, keyed by the node they start from. Each frontier is written: h hops
are h joins, and as the planner knows a frontier's size, a small one is broadcast. Restrictions on
nodes are applied before a hop, not after.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import MAX_DEPTH, Graph
from graphloom.scratch import written

# Nodes of a frontier up to which their ids are broadcast to the edges.
NEAR = 100_000


def keyed_edges(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges as (a, b, edge, type, confidence, forward); walking goes from a to b. `both` holds each edge twice under one key."""
    key = F.concat_ws("|", "type", "src", "dst")
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), key.alias("edge"), "type", "confidence", F.lit(True).alias("forward"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), key.alias("edge"), "type", "confidence", F.lit(False).alias("forward"))
    return {"out": out, "in": back}.get(direction) or out.unionByName(back.where("a <> b"))


def _within(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose `column` is one of few `ids(id)`: a broadcast that the planner moves below unions and duplicates' removal."""
    return rows.join(F.broadcast(ids), F.col(column) == F.col("id"), "left_semi")


class _Steps:
    """The edges that leave a frontier: (a, b, edge, type, confidence, forward)."""

    def __init__(self, edges: DataFrame, direction: str, allowed: DataFrame | None = None):
        self.edges, self.direction, self.allowed, self.whole = edges, direction, allowed, None

    def leaving(self, frontier: DataFrame) -> DataFrame:
        """Edges from the nodes of `frontier(node)`, a written table."""
        if self.whole is not None:
            return self.whole
        ids = written(frontier.select(F.col("node").alias("id")).where("id is not null").distinct(), "nodes")
        if ids.count() > NEAR:
            walk = keyed_edges(self.edges, self.direction)
            if self.allowed is not None:
                walk = walk.join(self.allowed.select(F.col("id").alias("b")), "b", "left_semi")
            self.whole = written(walk, "edges")
            return self.whole
        sides = {"out": [("src", "out")], "in": [("dst", "in")]}.get(self.direction) or [("src", "out"), ("dst", "in")]
        walks = [keyed_edges(_within(self.edges, end, ids), way) for end, way in sides]
        walk = walks[0] if len(walks) == 1 else walks[0].unionByName(walks[1].where("a <> b"))
        if self.allowed is None:
            return walk
        walk = written(walk, "edges")
        ends = written(walk.select(F.col("b").alias("id")).distinct(), "nodes")
        known = self.allowed.select("id")
        if ends.count() > NEAR:
            return walk.join(known.withColumnRenamed("id", "b"), "b", "left_semi")
        return _within(walk, "b", written(_within(known.withColumnRenamed("id", "known"), "known", ends).select(F.col("known").alias("id")), "nodes"))


def expand(seeds: DataFrame, edges: DataFrame, max_hops: int, direction: str = "out", allowed: DataFrame | None = None, stop_at: int | None = None) -> DataFrame:
    """All paths of 1..max_hops edges from `seeds(seed)`: seed, node, depth, nodes, edges, types, confidences.

    `allowed(id)`: the only nodes that may stand on a path, the seed included. `stop_at`: no longer
    paths are sought once this many were found (the shortest come first, so a limit by length is exact).
    Null and unknown seeds have no paths.
    """
    max_hops = min(max_hops, MAX_DEPTH)
    steps = _Steps(edges, direction, allowed)
    if allowed is not None:
        seeds = seeds.join(allowed.select(F.col("id").alias("seed")), "seed", "left_semi")
    empty = F.expr("cast(array() as array<string>)")
    level = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.array("seed").alias("nodes"), empty.alias("edges"), empty.alias("types"), empty.alias("confidences"))
    level = written(level, "paths")
    found, total = [], 0
    for _ in range(max_hops):
        f, w = level.alias("f"), steps.leaving(level).alias("w")
        level = (
            f.join(w, F.col("f.node") == F.col("w.a"))
            .where(~F.array_contains(F.col("f.edges"), F.col("w.edge")))
            .select(
                "f.seed", F.col("w.b").alias("node"), (F.col("f.depth") + 1).alias("depth"),
                F.array_append("f.nodes", F.col("w.b")).alias("nodes"), F.array_append("f.edges", F.col("w.edge")).alias("edges"),
                F.array_append("f.types", F.col("w.type")).alias("types"),
                F.array_append("f.confidences", F.coalesce("w.confidence", F.lit("HIGH"))).alias("confidences"),
            )
        )
        level = written(level, "paths")
        found.append(level)
        n = level.count()
        total += n
        if not n or (stop_at is not None and total >= stop_at):
            break
    return reduce(DataFrame.unionByName, found)


def reachable(seeds: DataFrame, edges: DataFrame, max_hops: int, direction: str = "out") -> DataFrame:
    """Distinct (seed, node) within 1..max_hops; no path bookkeeping, and nodes once met are not walked from again."""
    steps = _Steps(edges, direction)
    level, known = written(seeds.select("seed", F.col("seed").alias("node")).distinct(), "reached"), []
    for _ in range(max_hops):
        level = level.alias("f").join(steps.leaving(level).alias("w"), F.col("f.node") == F.col("w.a")).select("f.seed", F.col("w.b").alias("node")).distinct()
        if known:
            level = level.join(reduce(DataFrame.unionByName, known), ["seed", "node"], "left_anti")
        level = written(level, "reached")
        if level.isEmpty():
            break
        known.append(level)
    return reduce(DataFrame.unionByName, known) if known else level


def seeds_named(graph: Graph, name: str, *labels: str) -> DataFrame:
    chosen = graph.of(*labels) if labels else graph.nodes
    return chosen.where(F.col("name") == name).select(F.col("id").alias("seed"))
