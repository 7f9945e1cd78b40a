"""Input schemas: requests are checked on the driver before a plan is built, tables by one expression a field."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """What a value has to be. Without `required` it may be missing (null); `default` then takes its place."""

    kind: type = str
    required: bool = False
    default: Any = None
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()
    least_length: int = 0
    most_length: int | None = None


# The fields of requests and settings with their ranges, defaults and choices.
_NAME = Field(required=True, least_length=1)
_DEPTH = {"kind": int, "low": 1, "high": 10}
REQUESTS: dict[str, dict[str, Field]] = {
    "ingest_repo": {"url": _NAME, "branch": Field(default="main"), "token": Field()},
    "search_codebase": {
        "query": _NAME,
        "type": Field(choices=("Service", "API", "Database", "Repo", "File", "Module", "Config", "MessageQueue")),
        "limit": Field(int, default=20, low=1, high=100),
    },
    "get_dependencies": {"service": _NAME, "depth": Field(default=2, **_DEPTH)},
    "analyze_impact": {"node": _NAME, "changeType": Field(choices=("api_change", "db_change", "removal", "modification")), "depth": Field(default=3, **_DEPTH)},
    "get_service_summary": {"service": _NAME},
    "get_ingestion_status": {"repo": _NAME},
    "get_api_map": {"service": Field()},
    "settings": {
        "logLevel": Field(default="info", choices=("fatal", "error", "warn", "info", "debug", "trace")),
        "dataDir": Field(default="./data"),
        "maxRepoSizeMb": Field(float, default=1024, low=1e-9),
        "bulkConcurrency": Field(int, default=5, low=1, high=32),
        "ingestTimeoutMs": Field(int, default=600_000, low=60_000),
    },
}


def _problem(value: Any, f: Field) -> str | None:
    if value is None:
        return "required" if f.required else None
    if f.kind in (int, float):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if not number or f.kind is int and value != int(value):
            return f"not {f.kind.__name__}"
        return "too small" if f.low is not None and value < f.low else "too large" if f.high is not None and value > f.high else None
    if not isinstance(value, f.kind):
        return f"not {f.kind.__name__}"
    if f.kind is str:
        if len(value) < f.least_length:
            return "too short"
        if f.most_length is not None and len(value) > f.most_length:
            return "too long"
        if f.choices and value not in f.choices:
            return "not a choice"
    return None


def checked(request: str, values: Mapping[str, Any]) -> dict[str, Any]:
    """The request's fields with defaults filled in; fields it does not know are left out, all problems raise one ValueError."""
    out, problems = {}, []
    for name, f in REQUESTS[request].items():
        value = values.get(name)
        if value is None and not f.required:
            value = f.default
        said = _problem(value, f)
        if said:
            problems.append(f"{name}: {said}")
        if value is not None:
            out[name] = value
    if problems:
        raise ValueError(f"{request}: " + "; ".join(problems))
    return out


def violations(rows: DataFrame, fields: Mapping[str, Field]) -> DataFrame:
    """`rows` that break a rule, with `problems`: "field: problem" in the fields' order. Columns have their types already."""

    def said(name: str, f: Field) -> Column:
        c = F.col(f"`{name}`")
        rules: list[tuple[Column, str]] = [(c.isNull(), "required")] if f.required else []
        if f.low is not None:
            rules.append((c < f.low, "too small"))
        if f.high is not None:
            rules.append((c > f.high, "too large"))
        if f.least_length:
            rules.append((F.length(c) < f.least_length, "too short"))
        if f.most_length is not None:
            rules.append((F.length(c) > f.most_length, "too long"))
        if f.choices:
            rules.append((~c.isin(*f.choices), "not a choice"))
        return F.coalesce(*(F.when(broken, f"{name}: {text}") for broken, text in rules), F.lit(None).cast("string"))

    problems = F.array_compact(F.array(*(said(name, f) for name, f in fields.items())))
    return rows.withColumn("problems", problems).where(F.size("problems") > 0)
