"""Property-graph model: vocabularies, schemas and id rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closed vocabularies of the graph model.
NODE_LABELS = (
    "Service", "Repo", "File", "Module", "Database", "API", "Config", "MessageQueue", "Feature", "TestCase", "Doc", "Topic",
    "Table", "Column", "Migration", "Function", "Class", "Method", "TypeDef", "Owner", "Team", "Commit", "ConfigKey", "SecretRef",
)
CONFIDENCE = {"HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.4}
JOB_STATUSES = ("PENDING", "CLONING", "PARSING", "EXTRACTING", "COMPLETED", "FAILED")
ERROR_CATEGORIES = ("CLONE_FAILED", "PARSE_FAILED", "TIMEOUT", "NEO4J_LOCK", "OOM", "UNKNOWN")
MAX_DEPTH = 10

NODE_SCHEMA = "id string, label string, name string, repo_url string, props map<string,string>"
EDGE_SCHEMA = "src string, dst string, type string, confidence string, props map<string,string>"


@dataclass(frozen=True)
class Graph:
    """nodes(id, label, name, ...) and edges(src, dst, type, confidence, ...) as lazy DataFrames."""

    nodes: DataFrame
    edges: DataFrame

    def of(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.col("label").isin(*labels))

    def between(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types)) if types else self.edges


def confidence_score(c: Column) -> Column:
    """HIGH, MEDIUM and LOW as numbers; other values null."""
    out = F.lit(None).cast("double")
    for name, score in CONFIDENCE.items():
        out = F.when(c == name, F.lit(score)).otherwise(out)
    return out


def clamp(value: object, low: int, high: int) -> int:
    """Whole number in [low, high]; what is not a number counts as `low`."""
    try:
        n = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return low
    return low if n != n else int(max(low, min(high, n // 1)))
