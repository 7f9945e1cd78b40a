"""Scalar text functions as column expressions, and small pure helpers for plan building."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """Glob as an anchored regular expression: `**` anything, `*` and `?` within a path segment."""
    out = ""
    for token in re.findall(r"\*\*|\*|\?|[^*?]+", pattern):
        out += {"**": ".*", "*": "[^/]*", "?": "."}.get(token) or re.escape(token)
    return f"^{out}$"


def glob_any(c: Column, patterns: list[str]) -> Column:
    """True if a pattern matches; an empty list accepts all."""
    return c.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(True)


def owner_rule_regex(pattern: str) -> str:
    """CODEOWNERS pattern as a regular expression over a relative path."""
    if pattern == "*":
        return "^.*$"
    anchored, body = pattern.startswith("/"), pattern.strip("/")
    core = glob_regex(body)[1:-1]
    tail = "(?:/.*)?$" if pattern.endswith("/") or "*" not in body.rsplit("/", 1)[-1] else "$"
    return ("^" if anchored or "/" in body else "^(?:.*/)?") + core + tail


_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_RE2 = {r"\b": _EDGE, r"\s": "[\\t\\n\\f\\r ]", "k": "[k\u212a]", "s": "[s\u017f]"}


def sql_regex(pattern: str) -> str:
    """A case-blind pattern of lower-case letters, for Java, with SQL's meaning: words and spaces are ASCII, only a newline ends a line, k and s have a third form."""
    token = lambda m: m[0].replace(r"\s", r"\t\n\f\r ") if m[0][0] == "[" else _RE2.get(m[0], m[0])
    return "(?id)" + re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]|.", token, pattern)


def url_host(c: Column) -> Column:
    """Lower-case host of a URL; template holes `{x}` and `${x}` count as X."""
    return F.lower(F.regexp_extract(F.regexp_replace(c, r"\$?\{[^}]*\}", "X"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]*)", 1))


def url_path(c: Column) -> Column:
    """Path without query and fragment, `/` if empty."""
    path = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_hole(s: Column) -> Column:
    """A path segment that stands for any value: {x}, :x, ${x}."""
    return s.rlike(r"^(?::.+|\$?\{.*\})$")


def template_matches(template: Column, call: Column) -> Column:
    """Segment arrays of equal length whose literal segments agree."""
    same = F.forall(F.zip_with(template, call, lambda t, c: is_hole(t) | is_hole(c) | (F.lower(t) == F.lower(c))), lambda x: x)
    return (F.size(template) == F.size(call)) & same


def join_paths(a: Column, b: Column) -> Column:
    bare = lambda c: F.when(F.trim(c, F.lit("/")) != "", F.trim(c, F.lit("/")))
    return F.concat(F.lit("/"), F.concat_ws("/", bare(a), bare(b)))


def snake_plural(c: Column) -> Column:
    """CamelCase name as a snake_case plural table name."""
    snake = F.lower(F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))
    return F.when(snake.rlike("[^aeiou]y$"), F.regexp_replace(snake, "y$", "ies")).when(snake.rlike("(?:s|x|z|ch|sh)$"), F.concat(snake, F.lit("es"))).otherwise(F.concat(snake, F.lit("s")))


def truncated(c: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def line_count(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.size(F.split(c, "\n", -1)))


def line_of(c: Column, offset: Column) -> Column:
    """1-based line of a 0-based code point offset."""
    return F.size(F.split(F.substring(c, F.lit(1), offset.cast("int")), "\n", -1))


# Key names that hold secrets, and shapes of references to secret stores, in order.
SECRET_KEY = r"(?i)(SECRET|TOKEN|PASSWORD|API[_-]?KEY|CREDENTIAL|PRIVATE[_-]?KEY|BEARER|ACCESS[_-]?KEY)"
SECRET_VENDORS = (
    ("VAULT", r"(?i)^(?:vault:|secret/data/)"),
    ("AWS_SM", r"(?i)^arn:aws:secretsmanager:"),
    ("AWS_PARAMS", r"(?i)^arn:aws:ssm:.*:parameter/"),
    ("GCP_SECRETS", r"(?i)^projects/[^/]+/secrets/"),
    ("AZURE_KV", r"(?i)^https?://[a-z0-9-]+\.vault\.azure\.net/"),
)
# Error categories by message, in order.
ERROR_PATTERNS = (
    ("OOM", r"(?i)JS heap out of memory|allocation failed|out of memory"),
    ("NEO4J_LOCK", r"(?is)ForsetiClient.*can't acquire.*Lock|deadlock detected"),
    ("TIMEOUT", r"(?i)timed out after \d+ms|ETIMEDOUT|operation timed out"),
    ("CLONE_FAILED", r"(?i)clone failed|fatal: could not read|GitLab API|repository not found"),
    ("PARSE_FAILED", r"(?i)SyntaxError|Unexpected token|ts-morph"),
)
RETRYABLE = ("TIMEOUT", "NEO4J_LOCK")


def first_match(c: Column, patterns: tuple[tuple[str, str], ...], other: str = "UNKNOWN") -> Column:
    """Name of the first pattern that matches."""
    out = F.lit(other)
    for name, pattern in reversed(patterns):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def secret_key(c: Column) -> Column:
    return c.rlike(SECRET_KEY)


def secret_vendor(c: Column) -> Column:
    return first_match(F.trim(c), SECRET_VENDORS)


def error_category(c: Column) -> Column:
    return first_match(c, ERROR_PATTERNS)


def backoff_seconds(attempt: Column, base: float = 1.0) -> Column:
    """Wait before the next attempt, without its random part."""
    return F.lit(base) * F.pow(F.lit(4.0), attempt - 1)


def redacted(c: Column) -> Column:
    """Values of credential-like keys in `key=value` and `key: value` text, hidden."""
    return F.regexp_replace(c, sql_regex(r"(\b(?:password|passwd|secret|token|api[_-]?key|authorization)\b[\"']?\s*[:=]\s*[\"']?)[^\s\"',;#]+"), "$1[REDACTED]")


def chunks(c: Column, size: int = 2000, stride: int = 1700) -> Column:
    """Overlapping windows of a text; the last one is the first that reaches its end."""
    last = F.greatest(F.lit(0), F.ceil((F.length(c) - size) / stride)).cast("int")
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * stride + 1, F.lit(size)))).otherwise(F.expr("cast(array() as array<string>)"))


def percentile_rank_value(sorted_values: Column, p: float) -> Column:
    """sorted[min(n-1, floor(p*n))]."""
    n = F.size(sorted_values)
    return F.element_at(sorted_values, (F.least(n - 1, F.floor(F.lit(p) * n)) + 1).cast("int"))


_WRITES = re.compile(r"\b(CREATE|MERGE|SET|DELETE|REMOVE|DROP|FOREACH|LOAD\s+CSV|INSERT|UPDATE|ALTER|TRUNCATE|GRANT|REVOKE|CALL|EXEC|ADD|CACHE|REFRESH|MSCK|USE)\b", re.I)


def read_only(sql: str, most: int = 100) -> tuple[str | None, int]:
    """(why a statement is refused or None, rows that may be returned).

    Comments are stripped first. Only SELECT, WITH and VALUES statements without a writing
    keyword pass; a keyword inside a string literal is refused as well.
    """
    plain = re.sub(r"--[^\n]*|/\*.*?\*/|//[^\n]*", " ", sql, flags=re.S).strip().rstrip(";").strip()
    if not plain:
        return "empty statement", 0
    if ";" in plain:
        return "more than one statement", 0
    if found := _WRITES.search(plain):
        return f"keyword {found[1].upper()} is not allowed", 0
    if not re.match(r"(SELECT|WITH|VALUES)\b", plain, re.I):
        return "not a query", 0
    return None, max(1, min(500, most))
