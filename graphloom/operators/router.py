"""Question routing and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import sql_regex

# Question classes in priority order, and their patterns.
RULES = (
    ("topology", (r"\bdepends? on\b", r"\b(uses|using)\b", r"\bconsumers? of\b", r"\bcallers? of\b", r"\bservices? that (call|use)\b", r"\breverse dep(endenc(y|ies))?\b", r"\bwhat services\b")),
    ("schema", (r"\bwhich (table|column|field)\b", r"\bdatabase\b", r"\bschema\b", r"\bmodel\b", r"\bmigration\b")),
    ("api", (r"\bwhich (endpoint|api|route)\b", r"\bswagger\b", r"\bopenapi\b", r"\bgraphql\b", r"\brest (api|endpoint)\b")),
    ("flow", (r"\bend-?to-?end\b", r"\buser (flow|journey)\b", r"\bwhen .* (clicks|starts|signs|submits|logs in)\b", r"\bwhat happens when\b")),
    ("ownership", (r"\bwho owns\b", r"\bowners?\b", r"\bteam\b", r"\bmaintainer\b")),
    ("config", (r"\benv(ironment)? var(iable)?\b", r"\bsecret\b", r"\bconfig\b", r"\bfeature flag\b")),
    ("ops", (r"\bkafka topic\b", r"\bqueue\b", r"\bproducer\b", r"\bconsumer\b", r"\bconsumes\b", r"\bproduces\b")),
    ("history", (r"\bwhen did\b", r"\bhistory\b", r"\bfirst added\b", r"\bintroduced\b")),
    ("code", (r"\bwhere (is|do|does).*(implement|defined|calculate|compute)", r"\bfunction\b", r"\bmethod\b", r"\bhow is .* implemented\b")),
)
# Retrieval strategy of each class as (kind, template, label).
STRATEGIES = {
    "topology": ("graph-only", "topology", None), "schema": ("graph-then-hybrid", None, "Table"), "code": ("hybrid", None, "Function"),
    "flow": ("multi-hop", None, "API"), "ownership": ("graph-only", "ownership", None), "api": ("hybrid", None, "API"),
    "config": ("graph-only", "config", None), "ops": ("graph-only", "kafka", None), "history": ("graph-only", "commits", None),
    "unknown": ("hybrid", None, None),
}
# Words that are never service names.
STOPWORDS = (
    "what", "which", "who", "when", "where", "how", "why", "the", "a", "an", "is", "are", "do", "does", "did", "on", "in", "of", "to", "for", "and",
    "or", "with", "depends", "depend", "uses", "using", "use", "consumers", "consumer", "callers", "caller", "services", "service", "that", "call",
    "calls", "reverse", "dep", "deps", "database", "databases", "schema", "model", "migration", "table", "tables", "column", "columns", "field",
    "fields", "endpoint", "endpoints", "api", "apis", "route", "routes", "swagger", "openapi", "graphql", "rest", "env", "environment", "var",
    "variable", "secret", "secrets", "config", "feature", "flag", "flags", "kafka", "topic", "topics", "queue", "producer", "consumes", "produces",
    "function", "functions", "method", "methods", "class", "classes", "implement", "implemented", "defined", "calculate", "compute", "owns", "owners",
    "team", "teams", "maintainer", "history", "first", "added", "introduced", "happens", "flow", "journey", "user", "end", "this", "have", "has",
    "be",
)
# US dollars for 1,000 tokens in and out.
PRICES = {
    "gpt-4o": (0.0025, 0.01), "gpt-4o-mini": (0.00015, 0.0006), "gpt-4-turbo": (0.01, 0.03), "text-embedding-3-small": (0.00002, 0.0),
    "text-embedding-3-large": (0.00013, 0.0), "claude-3-5-sonnet-20241022": (0.003, 0.015), "claude-3-5-haiku-20241022": (0.0008, 0.004),
    "claude-3-opus-20240229": (0.015, 0.075), "voyage-3": (0.00006, 0.0), "voyage-code-2": (0.00012, 0.0), "rerank-english-v3.0": (0.001, 0.0),
    "ollama:default": (0.0, 0.0),
}
FALLBACK_PRICE = (0.005, 0.015)
# Fixed value: confidence below which a model may be asked.
MODEL_THRESHOLD = 0.4


def classify(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with class, confidence and signals of the question in `column`.

    The class with most matching patterns wins, earlier ones first among equals; confidence is
    0.3 if several classes match, else 0.6 and 0.1 for each further pattern, 0.95 at most.
    """
    q = F.trim(F.coalesce(column, F.lit("")))
    counts = [sum((q.rlike(sql_regex(p)).cast("int") for p in patterns), F.lit(0)) for _, patterns in RULES]
    best = F.greatest(*counts)
    several = sum(((c > 0).cast("int") for c in counts), F.lit(0)) > 1
    cls, signals = F.lit("unknown"), F.lit("")
    for (name, patterns), c in reversed(list(zip(RULES, counts))):
        won = (c == best) & (best > 0)
        cls = F.when(won, name).otherwise(cls)
        texts = F.array(*(F.regexp_extract(q, sql_regex(p), 0) for p in patterns))
        signals = F.when(won, F.array_join(F.filter(texts, lambda s: s != ""), "|")).otherwise(signals)
    confidence = F.when(best == 0, 0.0).when(several, 0.3).otherwise(F.round(F.least(F.lit(0.6) + 0.1 * (best - 1), F.lit(0.95)), 2))
    return rows.withColumns({"class": cls, "confidence": confidence, "signals": signals})


def with_strategy(rows: DataFrame) -> DataFrame:
    """Classified rows with the strategy's kind, template and label."""
    table = rows.sparkSession.createDataFrame([(c, *s) for c, s in STRATEGIES.items()], "class string, kind string, template string, label string")
    return rows.join(F.broadcast(table), "class", "left")  # ten rows


def with_fallback(rows: DataFrame, threshold: float = MODEL_THRESHOLD, enabled: bool = True) -> DataFrame:
    """Classified rows with `asks_model`: whether a model should class them, as the rules' confidence is below the threshold.

    Without a model (enabled=False) nothing is asked; a null confidence counts as 0.
    """
    return rows.withColumn("asks_model", F.lit(enabled) & (F.coalesce("confidence", F.lit(0.0)) < threshold))


def with_model_answers(rows: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Rows of with_fallback() where answers(key, class, confidence) take the place of the rules' result.

    Only rows that ask take one; answers of unknown classes are left out, and of several for one key the surest counts.
    """
    known = answers.where(F.col("class").isin(*STRATEGIES)).groupBy(key).agg(F.max_by(F.struct("class", "confidence"), F.struct("confidence", "class")).alias("answer"))
    use = F.col("asks_model") & F.col("answer").isNotNull()
    changed = {"class": F.when(use, F.col("answer.class")).otherwise(F.col("class")), "confidence": F.when(use, F.col("answer.confidence")).otherwise(F.col("confidence"))}
    return rows.join(known, key, "left").withColumns(changed).drop("answer")


def service_names(c: Column) -> Column:
    """Candidate service names of a question, in order, each once."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"\b([a-z][a-z0-9]+(?:-[a-z0-9]+)*(?:-(?:ui|service|api|gql|cli))?)\b"), F.lit(1))
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t) & (t.contains("-") | t.rlike("(?:service|api|gql|cli|ui)$"))))


def file_hint(c: Column) -> Column:
    return F.regexp_extract(c, r"([\w./-]+\.(?:tsx|ts|jsx|js|py|go|java|rs|rb|kt|cs|php|sql|ya?ml|json|md))\b", 1)


def env_hint(c: Column) -> Column:
    return F.regexp_extract(c, r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b", 1)


def first_word(c: Column) -> Column:
    return F.regexp_extract(c, "[A-Za-z][A-Za-z0-9-]*", 0)


def budget_breach(tokens: Column, dollars: Column, calls: Column, max_tokens: int = 8000, max_dollars: float = 0.5, max_calls: int = 5) -> Column:
    """The first limit that is passed, else null."""
    return F.when(tokens > max_tokens, "tokens").when(dollars > max_dollars, "dollars").when(calls > max_calls, "tool_calls")


def estimate_cost(rows: DataFrame, provider: str, model: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """`rows` with cost_usd (6 digits) and fallback: whether the model has no price of its own."""
    table = rows.sparkSession.createDataFrame([(m, *p) for m, p in PRICES.items()], f"{model} string, price_in double, price_out double")
    priced = rows.join(F.broadcast(table), model, "left")  # twelve rows
    free = F.col(provider) == "ollama"
    cost = F.col(tokens_in) / 1000 * F.coalesce("price_in", F.lit(FALLBACK_PRICE[0])) + F.col(tokens_out) / 1000 * F.coalesce("price_out", F.lit(FALLBACK_PRICE[1]))
    return priced.select(*rows.columns, F.when(free, 0.0).otherwise(F.round(cost, 6)).alias("cost_usd"), (~free & F.col("price_in").isNull()).alias("fallback"))


def _clean(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, lambda s: F.trim(s)), lambda s: s != ""))


def citation_overlap(predicted: Column, gold: Column) -> Column:
    """struct<tp,fp,fn,precision,recall>; nothing predicted is right only if nothing was to be found."""
    p, g = _clean(predicted), _clean(gold)
    tp, np_, ng = F.size(F.array_intersect(p, g)), F.size(p), F.size(g)
    precision = F.when(np_ == 0, F.when(ng == 0, 1.0).otherwise(0.0)).otherwise(tp / np_)
    return F.struct(tp.alias("tp"), (np_ - tp).alias("fp"), (ng - tp).alias("fn"), precision.alias("precision"), F.when(ng == 0, 1.0).otherwise(tp / ng).alias("recall"))


def faithfulness(answer: Column, citations: Column) -> Column:
    """Share of sentences with a [ref:...] marker or one of the citations; an empty answer has 0."""
    sentences = F.filter(F.transform(F.split(F.trim(answer), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    refs = _clean(citations)
    supported = F.filter(sentences, lambda s: s.rlike(r"(?i)\[ref:[^\]]+\]") | F.exists(refs, lambda r: F.contains(s, r)))
    return F.when(F.size(sentences) == 0, 0.0).otherwise(F.size(supported) / F.size(sentences))


def run_summary(cases: DataFrame) -> DataFrame:
    """One row over cases(class_correct, recall, precision, ok, judge): counts and averages to 4 digits."""
    return cases.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("class_correct") & (F.col("recall") > 0) & F.col("ok")).alias("passed"),
        F.round(F.avg("recall"), 4).alias("avg_recall"), F.round(F.avg("precision"), 4).alias("avg_precision"), F.round(F.avg("judge"), 4).alias("avg_judge"),
    )


def judge_score(c: Column) -> Column:
    """The first number of a reply if it lies in [0, 1], else null."""
    number = F.regexp_extract(c, r"-?[0-9]+(?:\.[0-9]+)?", 0)
    value = F.when(number != "", number.try_cast("double"))
    return F.when(value.between(0, 1), value)


def grounded(citations: Column, seen: Column) -> Column:
    """Citations that contain, or stand within, an id that was seen."""
    return F.filter(citations, lambda c: F.exists(seen, lambda s: F.contains(s, c) | F.contains(c, s)))


def embedded_json(c: Column) -> Column:
    """The JSON object in a reply: within a fence, else from the first { to the last }."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(c, r"(?s)(\{.*\})", 1))


