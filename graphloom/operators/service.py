"""The query facade: routing, dispatch, caches, merge-request statistics, runtime records."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import read_only
from graphloom.model import Graph
from graphloom.operators import graph as g
from graphloom.operators.router import STRATEGIES


def execute_plan(graph: Graph, cls: str, seeds: DataFrame, needle: str, hybrid: Callable[[], DataFrame]) -> tuple[DataFrame, list[str]]:
    """(rows, notes) for a question class: graph templates, multi-hop walks, or hybrid search as fallback."""
    kind, template, label = STRATEGIES.get(cls, STRATEGIES["unknown"])
    if kind == "graph-only":
        run = {"topology": lambda: g.topology(graph, seeds), "ownership": lambda: g.ownership(graph, seeds), "kafka": lambda: g.topic_use(graph, seeds)}.get(template)
        return (run(), [f"graph template {template}"]) if run else (hybrid(), [f"no template {template}; hybrid search"])
    if kind == "multi-hop":
        return g.multi_hop(graph, label, needle), [f"walk from {label}"]
    if kind == "graph-then-hybrid":
        rows = g.seed_nodes(graph, label, needle)
        return (hybrid(), [f"no {label} found; hybrid search"]) if rows.isEmpty() else (rows, [f"{label} lookup"])
    return hybrid(), ["hybrid search"]


def run_sql(spark, sql: str, most: int = 100) -> DataFrame:
    """A read-only SQL statement over temporary views, at most 500 rows."""
    why, rows = read_only(sql, most)
    if why:
        raise ValueError(why)
    return spark.sql(sql).limit(rows)


class QueryCache:
    """First-in first-out cache with a time to live; entries of one repository can be dropped together."""

    def __init__(self, size: int = 500, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.entries: OrderedDict[str, tuple[float, str, object]] = OrderedDict()

    def get(self, key: str):
        found = self.entries.get(key)
        if found and self.clock() - found[0] <= self.seconds:
            return found[2]
        self.entries.pop(key, None)
        return None

    def put(self, key: str, value: object, repo: str = "") -> None:
        self.entries.pop(key, None)
        while len(self.entries) >= self.size:
            self.entries.popitem(last=False)
        self.entries[key] = (self.clock(), repo, value)

    def drop_repo(self, repo: str) -> int:
        gone = [k for k, e in self.entries.items() if e[1] == repo]
        for k in gone:
            del self.entries[k]
        return len(gone)


def diff_stats(changes: DataFrame) -> DataFrame:
    """changes(path, diff, new, deleted, renamed): one row of counts of files and of added and removed lines."""
    lines = lambda p: F.size(F.filter(F.split("diff", "\n"), lambda x: x.rlike(p)))
    rows = changes.select("path", lines(r"^\+(?!\+\+)").alias("added"), lines(r"^-(?!--)").alias("removed"), "new", "deleted", "renamed")
    return rows.agg(
        F.count(F.lit(1)).alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"),
        F.count_if("new").alias("new_files"), F.count_if("deleted").alias("deleted_files"), F.count_if("renamed").alias("renamed_files"),
    )


def first_of(record: Column, *paths: str) -> Column:
    """The first of several JSON paths that a record has."""
    return F.coalesce(*(F.get_json_object(record, p) for p in paths))


def rollup_services(uses: DataFrame, files: DataFrame) -> DataFrame:
    """File-level uses(path, target) lifted to services by files(path, service): distinct, marked as inferred."""
    return uses.join(files, "path").select("service", "target").distinct().withColumn("inferred", F.lit(True))


def flatten_keys(schema: Column, depth: int = 4, width: int = 50) -> Column:
    """Dotted property paths of a JSON schema text, at most `width` a level."""

    @F.pandas_udf("array<string>")
    def run(texts):
        import json

        def walk(x, at, level):
            if level >= depth or not isinstance(x, dict):
                return
            for k, v in list((x.get("properties") or {}).items())[:width]:
                path = f"{at}.{k}" if at else k
                yield path
                yield from walk(v, path, level + 1)
            if isinstance(x.get("items"), dict):
                yield from walk(x["items"], at, level)

        def of(text):
            try:
                return list(walk(json.loads(text or ""), "", 0))
            except ValueError:
                return []

        return texts.map(of)

    return run(schema)
