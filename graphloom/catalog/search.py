"""Search, routing, resolution and text functions over the driver tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as x
from graphloom.operators import resolve as rs
from graphloom.operators import router as r
from graphloom.operators import search as s
from graphloom.plans.projection import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Questions whose classes differ, for the router.
QUESTIONS = (
    "What services depends on billing-api?", "Which table stores invoices in the database schema?", "Which endpoint is in the openapi spec?",
    "What happens when a user clicks pay?", "Who owns the payments-service team?", "Which env variable and secret is the config for src/app/main.ts?",
    "Which kafka topic produces DATABASE_URL?", "When did history of auth-gql change?", "Where is the retry function implemented?", "hello there", "",
    "services that call user-ui using a queue", "how is checkout-cli implemented",
)


def query(name: str, sql: str | None, *names: str):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def literal(name: str, sql: str | None):
    """Register f(spark) over inline rows."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark)
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _values(column: str, rows) -> str:
    return f"(SELECT unnest([{', '.join(chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in rows)}]) AS {column})"


def _questions(spark):
    return spark.createDataFrame([(q,) for q in QUESTIONS], "q string")


_Q = _values("q", QUESTIONS)


def _class_sql() -> str:
    counts = [" + ".join(f"CAST(regexp_matches(trim(q), '(?i){p}') AS INT)" for p in patterns) for _, patterns in r.RULES]
    names = ", ".join(f"{c} AS c{i}" for i, c in enumerate(counts))
    greatest = "greatest(" + ", ".join(f"c{i}" for i in range(len(counts))) + ")"
    case = " ".join(f"WHEN c{i} = best THEN '{name}'" for i, (name, _) in enumerate(r.RULES))
    several = " + ".join(f"CAST(c{i} > 0 AS INT)" for i in range(len(counts)))
    return f"""SELECT q, CASE WHEN best = 0 THEN 'unknown' {case} END AS class, CASE WHEN best = 0 THEN 0.0 WHEN {several} > 1 THEN 0.3 ELSE round(least(0.6 + 0.1 * (best - 1), 0.95), 2) END AS confidence
      FROM (SELECT *, {greatest} AS best FROM (SELECT q, {names} FROM {_Q}))"""


literal("r01_classify", _class_sql())(lambda spark: r.classify(_questions(spark), "q").select("q", "class", "confidence"))
_KINDS = " ".join(f"WHEN '{c}' THEN '{k}'" for c, (k, _, _) in r.STRATEGIES.items())
literal("r02_strategy", f"SELECT q, CASE class {_KINDS} END AS kind FROM ({_class_sql()})")(lambda spark: r.with_strategy(r.classify(_questions(spark), "q")).select("q", "kind"))
query("r01b_classify_turns", f"SELECT conv_id, turn, class FROM (SELECT conv_id, turn, q FROM (SELECT conv_id, turn, text AS q FROM conversations WHERE role = 'user')) JOIN (SELECT DISTINCT q, class FROM ({_class_sql().replace(_Q, '(SELECT DISTINCT text AS q FROM conversations)')})) USING (q)", "conversations")(
    lambda conversations: r.classify(conversations.where("role = 'user'"), "text").select("conv_id", "turn", "class")
)
_STOP = "[" + ", ".join(f"'{w}'" for w in r.STOPWORDS) + "]"
literal("r03_service_names", f"""SELECT q, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(q), '\\b([a-z][a-z0-9]+(?:-[a-z0-9]+)*(?:-(?:ui|service|api|gql|cli))?)\\b', 1),
  lambda t: length(t) >= 3 AND NOT list_contains({_STOP}, t) AND (contains(t, '-') OR regexp_matches(t, '(?:service|api|gql|cli|ui)$'))))), ','), '') AS names FROM {_Q}""")(
    lambda spark: _questions(spark).select("q", F.array_join(F.array_sort(r.service_names(F.col("q"))), ",").alias("names"))
)
literal("r04_entity_hints", rf"SELECT q, regexp_extract(q, '([\w./-]+\.(?:tsx|ts|jsx|js|py|go|java|rs|rb|kt|cs|php|sql|ya?ml|json|md))\b', 1) AS file, regexp_extract(q, '\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b', 1) AS env FROM {_Q}")(
    lambda spark: _questions(spark).select("q", r.file_hint(F.col("q")).alias("file"), r.env_hint(F.col("q")).alias("env"))
)
literal("r05_first_word", f"SELECT q, regexp_extract(q, '[A-Za-z][A-Za-z0-9-]*', 0) AS word FROM {_Q}")(lambda spark: _questions(spark).select("q", r.first_word(F.col("q")).alias("word")))

query("v01_bm25", """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM documents),
  c AS (SELECT doc_id, len(w) AS l, len(list_filter(w, lambda t: t = 'idiot')) AS a, len(list_filter(w, lambda t: t = 'license')) AS b FROM d),
  s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
  SELECT doc_id, round(greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + greatest(1e-6, ln((n - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score
  FROM c, s WHERE a > 0 OR b > 0 ORDER BY score DESC, doc_id LIMIT 50""", "documents")(
    lambda documents: s.bm25(documents, "doc_id", ["text"], "idiot license", stemming=False).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
)
query("v01b_bm25_stemmed", None, "documents")(lambda documents: s.bm25(documents, "doc_id", ["text"], "licensing licensed", k=20))
_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"
query("t02_cosine_top_k", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 20", "embeddings")(lambda e: _nearest(e, 20))
query("v12_semantic_search", f"SELECT vec_id, CAST(label AS VARCHAR) AS label, round({_COS}, 4) AS score FROM embeddings WHERE label IN (1, 2) ORDER BY {_COS} DESC, vec_id LIMIT 10", "embeddings")(
    lambda e: s.vector_top_k(e.where("label in (1, 2)"), "vec_id", "embedding", _vector(e, 0), 10).join(e.select(F.col("vec_id").alias("key"), "label"), "key").select(F.col("key").alias("vec_id"), F.col("label").cast("string").alias("label"), F.round("score", 4).alias("score"))
)


def _vector(embeddings, vec_id: int) -> list[float]:
    return embeddings.where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _nearest(embeddings, k: int):
    return s.vector_top_k(embeddings, "vec_id", "embedding", _vector(embeddings, 0), k).select(F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


_LEGS = f"""WITH a AS (SELECT doc_id AS key, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50),
  b AS (SELECT vec_id AS key, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 50)"""


def _legs(documents, embeddings):
    longest = documents.orderBy(F.desc("n_chars"), "doc_id").limit(50).select(F.col("doc_id").alias("key"), F.col("n_chars").cast("double").alias("score"))
    return s.ranked(longest, "bm25").unionByName(s.ranked(s.vector_top_k(embeddings, "vec_id", "embedding", _vector(embeddings, 0), 50), "vector"))


query("v04_rrf", _LEGS + " SELECT key, round(sum(1.0 / (60 + rank)), 6) AS score, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM (SELECT *, 'bm25' AS src FROM a UNION ALL SELECT *, 'vector' FROM b) GROUP BY 1", "documents", "embeddings")(
    lambda d, e: s.rrf(_legs(d, e)).select("key", F.round("score", 6).alias("score"), "sources")
)
query("v05_hybrid", None, "documents", "embeddings")(lambda d, e: s.hybrid(d, "doc_id", ["text"], "idiot license", e, "vec_id", "embedding", _vector(e, 0), k=20))
query("v05b_hybrid_vector_mode", f"SELECT vec_id AS key, round(1.0 / (60 + row_number() OVER (ORDER BY {_COS} DESC, vec_id)), 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10", "documents", "embeddings")(
    lambda d, e: s.hybrid(d, "doc_id", ["text"], "x", e, "vec_id", "embedding", _vector(e, 0), k=10, mode="vector").select("key", F.round("score", 6).alias("score"))
)
query("j17_fusion_join", _LEGS + " SELECT coalesce(a.key, b.key) AS key, a.rank AS bm25_rank, b.rank AS vector_rank FROM a FULL JOIN b ON a.key = b.key", "documents", "embeddings")(
    lambda d, e: (lambda legs: legs.groupBy("key").agg(F.max(F.when(F.col("source") == "bm25", F.col("rank"))).alias("bm25_rank"), F.max(F.when(F.col("source") == "vector", F.col("rank"))).alias("vector_rank")))(_legs(d, e))
)
query("v06_rerank", "SELECT doc_id AS key, coalesce(CASE WHEN doc_id % 2 = 0 THEN doc_id / 2.0 END, 0.0) AS rerank_score FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30)", "documents")(
    lambda d: s.reranked(d.orderBy(F.desc("n_chars"), "doc_id").limit(30).select(F.col("doc_id").alias("key"), F.lit(0.0).alias("score")), d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), (F.col("doc_id") / 2.0).alias("rerank_score"))).select("key", "rerank_score")
)
query("v07_index_rows", "SELECT 'Doc' AS label, doc_id AS node_id, lang AS name, source AS path, text AS body FROM documents UNION ALL SELECT 'API', p_partkey, p_name, p_type, p_brand FROM part", "documents", "part")(
    lambda d, p: d.select(F.lit("Doc").alias("label"), F.col("doc_id").alias("node_id"), F.col("lang").alias("name"), F.col("source").alias("path"), F.col("text").alias("body"))
    .unionByName(p.select(F.lit("API").alias("label"), F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.col("p_type").alias("path"), F.col("p_brand").alias("body")))
)
query("v08_embeddable_text", "SELECT p_partkey, concat_ws(' ', nullif(trim(p_name), ''), nullif(trim(p_brand), ''), CASE WHEN p_size > 25 THEN 'large' END) AS body FROM part", "part")(
    lambda p: p.select("p_partkey", F.concat_ws(" ", *(F.when(F.trim(c) != "", F.trim(c)) for c in ("p_name", "p_brand")), F.when(F.col("p_size") > 25, "large")).alias("body"))
)
query("v09_chunks", "SELECT doc_id, i AS pos, md5(substring(text, CAST(i * 1700 + 1 AS BIGINT), 2000)) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 2000) / 1700.0)) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)", "documents")(
    lambda d: d.select("doc_id", F.posexplode(x.chunks(F.col("text"))).alias("pos", "c")).select("doc_id", "pos", F.md5("c").alias("chunk"))
)
query("v11_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents", "documents")(lambda d: d.select("doc_id", F.sha2("text", 256).alias("hash")))
query("f15_ids", "SELECT c_custkey, sha256(c_name || '::' || c_mktsegment) AS id FROM customer", "customer")(lambda c: c.select("c_custkey", F.sha2(F.concat_ws("::", "c_name", "c_mktsegment"), 256).alias("id")))

_FILES = "(SELECT source AS repo, 'doc/' || doc_id AS path, text AS content FROM documents)"


def _files(d):
    return d.select(F.col("source").alias("repo"), F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("text").alias("content"))


_LINES = f"(SELECT repo, path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM {_FILES})"
query("f20_code_grep", f"SELECT repo, path, line, substring(text, 1, 240) AS text FROM {_LINES} WHERE contains(lower(text), 'license') ORDER BY repo, path, line LIMIT 500", "documents")(lambda d: s.grep(_files(d), "LICENSE", ignore_case=True))
query("f20b_code_grep_regex", f"SELECT repo, path, line, substring(text, 1, 240) AS text FROM {_LINES} WHERE regexp_matches(text, 'token = \"[0-9a-f]+\"') ORDER BY repo, path, line LIMIT 500", "documents")(lambda d: s.grep(_files(d), 'token = "[0-9a-f]+"', regex=True))
query("f29_line_slice", f"SELECT path, line, line || ': ' || text AS row FROM {_LINES} WHERE line BETWEEN 2 AND 4", "documents")(
    lambda d: _files(d).select("path", F.posexplode(F.split("content", "\n", -1)).alias("n", "text")).withColumn("line", F.col("n") + 1).where("line between 2 and 4").select("path", "line", F.concat_ws(": ", F.col("line").cast("string"), "text").alias("row"))
)
query("f19_line_of_offset", "SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(string_split(substring(text, 1, 300), chr(10))) AS line FROM documents WHERE text <> ''", "documents")(
    lambda d: d.where("text <> ''").select("doc_id", x.line_count(F.col("text")).alias("lines"), x.line_of(F.col("text"), F.lit(300)).alias("line"))
)
query("f16_truncate", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '…' ELSE text END AS cut FROM documents", "documents")(lambda d: d.select("doc_id", x.truncated(F.col("text"), 80).alias("cut")))
query("f01_case", "SELECT c_custkey, lower(c_name) AS l, upper(c_mktsegment) AS u, trim(c_name) AS t FROM customer", "customer")(lambda c: c.select("c_custkey", F.lower("c_name").alias("l"), F.upper("c_mktsegment").alias("u"), F.trim("c_name").alias("t")))
query("f02_contains", "SELECT p_partkey, contains(p_name, 'red') AS a, starts_with(p_name, 'small') AS b, ends_with(p_name, 'ring') AS c FROM part", "part")(
    lambda p: p.select("p_partkey", p.p_name.contains("red").alias("a"), p.p_name.startswith("small").alias("b"), p.p_name.endswith("ring").alias("c"))
)
query("f05_list_filter", "SELECT conv_id, array_to_string(list_sort(list_filter(list(role), lambda r: r <> 'user')), ',') AS others FROM conversations GROUP BY 1", "conversations")(
    lambda c: c.groupBy("conv_id").agg(F.array_join(F.array_sort(F.filter(F.collect_list("role"), lambda z: z != "user")), ",").alias("others"))
)
query("f09_regex", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS n, regexp_replace(substring(text, 1, 60), '[^A-Za-z]+', '_', 'g') AS slug FROM documents", "documents")(
    lambda d: d.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("n"), F.regexp_replace(F.substring("text", 1, 60), "[^A-Za-z]+", "_").alias("slug"))
)
query("f10_url_parse", r"SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS path FROM pages", "pages")(
    lambda p: p.select("page_id", x.url_host(F.col("url")).alias("host"), x.url_path(F.col("url")).alias("path"))
)
query("f12_host_label", r"SELECT page_id, regexp_extract(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1), '^([^.]*)', 1) AS label FROM pages", "pages")(lambda p: p.select("page_id", F.split_part(x.url_host(F.col("url")), F.lit("."), F.lit(1)).alias("label")))
query("f14_table_names", "SELECT p_partkey, CASE WHEN regexp_matches(n, '[^aeiou]y$') THEN regexp_replace(n, 'y$', 'ies') WHEN regexp_matches(n, '(?:s|x|z|ch|sh)$') THEN n || 'es' ELSE n || 's' END AS t FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS n FROM part)", "part")(
    lambda p: p.select("p_partkey", x.snake_plural(F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).alias("t"))
)
query("f17_round", "SELECT c_custkey, round(c_acctbal / 7, 4) AS r FROM customer", "customer")(lambda c: c.select("c_custkey", F.round(F.col("c_acctbal") / 7, 4).alias("r")))
query("f18_math", "SELECT c_custkey, floor(c_acctbal) AS f, round(sqrt(abs(c_acctbal)), 6) AS s, least(10, greatest(1, c_nationkey)) AS c FROM customer", "customer")(
    lambda c: c.select("c_custkey", F.floor("c_acctbal").alias("f"), F.round(F.sqrt(F.abs("c_acctbal")), 6).alias("s"), F.least(F.lit(10), F.greatest(F.lit(1), "c_nationkey")).alias("c"))
)
query("f24_norms", "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings", "embeddings")(lambda e: e.select("vec_id", F.round(F.sqrt(s.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm")))
query("f25_sets", "SELECT conv_id, len(list_distinct(list(role))) AS kinds, list_contains(list(role), 'system') AS has_system FROM conversations GROUP BY 1", "conversations")(
    lambda c: c.groupBy("conv_id").agg(F.size(F.array_distinct(F.collect_list("role"))).alias("kinds"), F.array_contains(F.collect_list("role"), "system").alias("has_system"))
)
query("f26_map_sort", "SELECT source, string_agg(lang || '=' || n, ',' ORDER BY n DESC, lang) AS kinds FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1", "documents")(
    lambda d: d.groupBy("source", "lang").count().groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("m"), "lang", "count"))), lambda z: F.concat_ws("=", z["lang"], z["count"].cast("string"))), ",").alias("kinds"))
)
query("f28_redact", r"""SELECT doc_id, regexp_replace(text, '(?i)(\b(?:password|passwd|secret|token|api[_-]?key|authorization)\b["'']?\s*[:=]\s*["'']?)[^\s"'',;#]+', '\1[REDACTED]', 'g') AS text FROM documents""", "documents")(
    lambda d: d.select("doc_id", x.redacted(F.col("text")).alias("text"))
)

_KEYS = ("DB_PASSWORD", "HOST", "api-key", "accessKeyId", "STRIPE_TOKEN", "port", "PRIVATE_KEY_PATH")
literal("x28_secret_keys", f"SELECT k, regexp_matches(k, '(?i)(SECRET|TOKEN|PASSWORD|API[_-]?KEY|CREDENTIAL|PRIVATE[_-]?KEY|BEARER|ACCESS[_-]?KEY)') AS secret FROM {_values('k', _KEYS)}")(
    lambda spark: spark.createDataFrame([(k,) for k in _KEYS], "k string").select("k", x.secret_key(F.col("k")).alias("secret"))
)
_REFS = ("vault:a/b", "secret/data/x", "arn:aws:secretsmanager:eu:1:x", "arn:aws:ssm:eu:1:parameter/x", "projects/p/secrets/s", "https://kv1.vault.azure.net/secrets/x", "plain")
literal("x28b_secret_vendors", "SELECT v, CASE " + " ".join(f"WHEN regexp_matches(trim(v), '{p}') THEN '{n}'" for n, p in x.SECRET_VENDORS) + f" ELSE 'UNKNOWN' END AS vendor FROM {_values('v', _REFS)}")(
    lambda spark: spark.createDataFrame([(v,) for v in _REFS], "v string").select("v", x.secret_vendor(F.col("v")).alias("vendor"))
)
_ERRORS = ("request timed out after 300ms", "JS heap out of memory; operation timed out", "ForsetiClient[1] can't acquire ExclusiveLock", "fatal: could not read from remote", "SyntaxError: bad", "other")
_ERR = "CASE " + " ".join(f"WHEN regexp_matches(m, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in x.ERROR_PATTERNS) + " ELSE 'UNKNOWN' END"
literal("r13_classify_errors", f"SELECT m, {_ERR} AS category, {_ERR} IN ('TIMEOUT', 'NEO4J_LOCK') AS retryable FROM {_values('m', _ERRORS)}")(
    lambda spark: spark.createDataFrame([(m,) for m in _ERRORS], "m string").select("m", x.error_category(F.col("m")).alias("category"), x.error_category(F.col("m")).isin(*x.RETRYABLE).alias("retryable"))
)
literal("r13b_backoff", "SELECT a AS attempt, CAST(pow(4, a - 1) AS DOUBLE) AS wait FROM (SELECT unnest([1, 2, 3]) AS a)")(lambda spark: spark.range(1, 4).select(F.col("id").cast("int").alias("attempt"), x.backoff_seconds(F.col("id")).alias("wait")))

query("r12_cost", "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE round(event_id * CASE user_id % 3 WHEN 0 THEN 0.0025 WHEN 1 THEN 0.00006 ELSE 0.005 END + user_id * CASE user_id % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 0.0 ELSE 0.015 END, 6) END AS cost_usd, user_id % 5 <> 0 AND user_id % 3 = 2 AS fallback FROM events", "events")(
    lambda e: r.estimate_cost(e.select("event_id", (F.col("event_id") * 1000).alias("tin"), (F.col("user_id") * 1000).alias("tout"), F.when(F.col("user_id") % 5 == 0, "ollama").otherwise("x").alias("p"), F.when(F.col("user_id") % 3 == 0, "gpt-4o").when(F.col("user_id") % 3 == 1, "voyage-3").otherwise("none").alias("m")), "p", "m", "tin", "tout").select("event_id", "cost_usd", "fallback")
)
query("r11_budget", "SELECT event_id, CASE WHEN event_id % 10000 > 8000 THEN 'tokens' WHEN value / 100 > 0.5 THEN 'dollars' WHEN user_id % 8 > 5 THEN 'tool_calls' END AS breach FROM events", "events")(
    lambda e: e.select("event_id", r.budget_breach(F.col("event_id") % 10000, F.col("value") / 100, F.col("user_id") % 8).alias("breach"))
)
query("a12_citation_overlap", """SELECT conv_id, len(list_intersect(p, g)) AS tp, CASE WHEN len(p) = 0 THEN CASE WHEN len(g) = 0 THEN 1.0 ELSE 0.0 END ELSE round(len(list_intersect(p, g)) / len(p), 6) END AS "precision", CASE WHEN len(g) = 0 THEN 1.0 ELSE round(len(list_intersect(p, g)) / len(g), 6) END AS recall
  FROM (SELECT conv_id, coalesce(list(DISTINCT role || turn) FILTER (turn % 2 = 0), []) AS p, coalesce(list(DISTINCT role || turn) FILTER (turn % 3 = 0), []) AS g FROM conversations GROUP BY 1)""", "conversations")(
    lambda c: c.groupBy("conv_id").agg(*(F.collect_set(F.when(F.col("turn") % k == 0, F.concat("role", F.col("turn").cast("string")))).alias(n) for k, n in ((2, "p"), (3, "g"))))
    .select("conv_id", r.citation_overlap(F.col("p"), F.col("g")).alias("o")).select("conv_id", "o.tp", F.round("o.precision", 6).alias("precision"), F.round("o.recall", 6).alias("recall"))
)
literal("a13_faithfulness", None)(
    lambda spark: spark.createDataFrame([(1, "It uses A. See [ref:x]. Unknown!", ["A"]), (2, "", ["A"]), (3, "None here", [])], "id int, answer string, cites array<string>").select("id", F.round(r.faithfulness(F.col("answer"), F.col("cites")), 6).alias("f"))
)
ORACLE_SQL["a13_faithfulness"] = "SELECT * FROM (VALUES (1, 0.666667), (2, 0.0), (3, 0.0)) t(id, f)"
query("a14_eval_summary", "SELECT count(*) AS total, count(*) FILTER (quality = 1 AND toxic = 0) AS passed, round(avg(quality), 4) AS avg_recall, round(avg(toxic), 4) AS avg_precision, round(avg(CASE WHEN doc_id % 2 = 0 THEN quality END), 4) AS avg_judge FROM labels", "labels")(
    lambda l: r.run_summary(l.select((F.col("quality") == 1).alias("class_correct"), F.col("quality").alias("recall"), F.col("toxic").alias("precision"), (F.col("toxic") == 0).alias("ok"), F.when(F.col("doc_id") % 2 == 0, F.col("quality")).alias("judge")))
)
_REPLIES = ("score: 0.75 of 1", "1", "7 out of 10", "no number", "-0.2")
literal("r14_judge_score", f"SELECT v, CASE WHEN n BETWEEN 0 AND 1 THEN n END AS score FROM (SELECT v, TRY_CAST(regexp_extract(v, '-?[0-9]+(?:\\.[0-9]+)?', 0) AS DOUBLE) AS n FROM {_values('v', _REPLIES)})")(
    lambda spark: spark.createDataFrame([(v,) for v in _REPLIES], "v string").select("v", r.judge_score(F.col("v")).alias("score"))
)
literal("r10_answer_contract", "SELECT * FROM (VALUES (1, '{\"a\": 1}', 'svc:a'), (2, '{\"b\": 2}', '')) t(id, json, kept)")(
    lambda spark: spark.createDataFrame([(1, "text ```json\n{\"a\": 1}\n``` more", ["svc:a", "zzz"]), (2, "so {\"b\": 2} end", ["q"])], "id int, reply string, cites array<string>").select("id", r.embedded_json(F.col("reply")).alias("json"), F.array_join(r.grounded(F.col("cites"), F.array(F.lit("Service svc:a"))), ",").alias("kept"))
)
query("r16_service_mapping", "SELECT s_suppkey, replace('prod-{service}-eu', '{service}', lower(s_name)) AS name FROM supplier", "supplier")(lambda p: p.select("s_suppkey", F.replace(F.lit("prod-{service}-eu"), F.lit("{service}"), F.lower("s_name")).alias("name")))
query("r18_runtime_health", "SELECT user_id, max(value) FILTER (event_type = 'error') AS error_rate, max(value) FILTER (event_type = 'click') AS rps, max(value) FILTER (event_type = 'view') AS p99 FROM events GROUP BY 1", "events")(
    lambda e: e.groupBy("user_id").agg(*(F.max(F.when(F.col("event_type").endswith(k), F.col("value"))).alias(n) for k, n in (("error", "error_rate"), ("click", "rps"), ("view", "p99"))))
)
query("r19_seen_ids", "SELECT DISTINCT id FROM (SELECT 'order:' || o_orderkey AS id FROM orders UNION ALL SELECT 'customer:' || o_custkey FROM orders)", "orders")(
    lambda o: o.select(F.explode(F.array(F.concat(F.lit("order:"), "o_orderkey"), F.concat(F.lit("customer:"), "o_custkey"))).alias("id")).distinct()
)
query("p10_glob_allow", "SELECT page_id FROM pages WHERE regexp_matches(url, '^https://.*/en/[^/]*$') OR regexp_matches(url, '^http://.*/fr/.*$')", "pages")(lambda p: p.where(x.glob_any(F.col("url"), ["https://**/en/*", "http://**/fr/**"])).select("page_id"))
query("p12_push_skip", "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'new_branch' WHEN value < 5 THEN 'no_commits' WHEN event_type = 'view' THEN 'not_a_branch' END AS skip FROM events", "events")(
    lambda e: e.select("event_id", F.when(F.col("user_id") % 7 == 0, "new_branch").when(F.col("value") < 5, "no_commits").when(F.col("event_type") == "view", "not_a_branch").alias("skip"))
)
query("p13_capability_rank", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND s_nationkey % 3 = 1 ORDER BY s_acctbal DESC, s_suppkey LIMIT 25", "supplier")(
    lambda p: p.withColumn("caps", F.array((F.col("s_nationkey") % 3).cast("string"))).where((F.col("s_acctbal") > 0) & F.array_contains("caps", "1")).orderBy(F.desc("s_acctbal"), "s_suppkey").limit(25).select("s_suppkey")
)


def _apis(spark):
    rows = [
        (1, "GET", "/{lang}/{id}", ["Blog.tionsh.example.net"], None), (2, "GET", "/en/{id}", [], "thther-service"),
        (3, "POST", "/en/{id}", [], None), (4, "GET", "/fr/:id", ["m.ththth.example.net"], "ththhe-api"),
    ]
    return spark.createDataFrame(rows, "api_id int, method string, template string, hosts array<string>, service string")


QUERIES["j08_resolve_apis"] = lambda spark, sf_dir: rs.resolve_apis(table(spark, sf_dir, "pages").select(F.col("page_id").alias("call_id"), F.lit("get").alias("method"), "url"), _apis(spark))
ORACLE_SQL["j08_resolve_apis"] = r"""WITH a(api_id, re, literal, host, service) AS (VALUES (1, '^/+[^/]+/+[^/]+/*$', 0, 'blog.tionsh.example.net', NULL), (2, '^/+en/+[^/]+/*$', 1, NULL, 'thther'), (4, '^/+fr/+[^/]+/*$', 1, 'm.ththth.example.net', 'ththhe')),
  p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
  m AS (SELECT page_id, api_id, literal, count(*) OVER (PARTITION BY page_id) AS n, CASE WHEN host = h THEN 0 WHEN contains(split_part(h, '.', 1), service) OR contains(service, split_part(h, '.', 1)) THEN 2 ELSE 3 END AS r FROM p, a WHERE regexp_matches(path, re)),
  b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY r, CASE WHEN r = 3 THEN -literal ELSE 0 END, api_id) AS k FROM m)
  SELECT p.page_id AS call_id, api_id, CASE WHEN r = 0 AND n = 1 THEN 'HIGH' WHEN r < 3 THEN 'MEDIUM' WHEN r = 3 THEN 'LOW' END AS confidence,
    CASE r WHEN 0 THEN 'exact-host+path' WHEN 2 THEN 'fuzzy-host+path' WHEN 3 THEN 'path-only-no-host-match' ELSE 'no-match' END AS reason FROM p LEFT JOIN b ON b.page_id = p.page_id AND k = 1"""
_SERVICES = ((1, "m"), (2, "Blog"), (3, "www"), (4, "thther"), (5, "cheap_pills"), (6, "example"))
QUERIES["j09_resolve_services"] = lambda spark, sf_dir: rs.resolve_services(table(spark, sf_dir, "pages").select(F.col("page_id").alias("url_id"), "url"), spark.createDataFrame(list(_SERVICES), "service_id int, name string"))
ORACLE_SQL["j09_resolve_services"] = rf"""WITH s(service_id, name) AS (SELECT i, lower(n) FROM (VALUES {", ".join(f"({i}, '{n}')" for i, n in _SERVICES)}) t(i, n)),
  u AS (SELECT page_id AS url_id, lower(url) AS low, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host FROM pages),
  m AS (SELECT url_id, service_id, CASE WHEN host = name OR starts_with(host, name || '.') OR starts_with(host, name || '-') THEN 0
    WHEN length(name) > 2 AND (contains(low, name) OR contains(low, replace(name, '-', '_')) OR contains(low, replace(name, '_', '-'))) THEN 2 END AS r FROM u, s),
  b AS (SELECT *, row_number() OVER (PARTITION BY url_id ORDER BY r, service_id) AS k FROM m WHERE r IS NOT NULL)
  SELECT u.url_id, service_id, CASE r WHEN 0 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' END AS confidence FROM u LEFT JOIN b ON b.url_id = u.url_id AND k = 1"""
QUERIES["j10_service_of_files"] = lambda spark, sf_dir: rs.service_of_files(
    table(spark, sf_dir, "part").select(F.concat_ws("/", F.lit("src"), "p_type", "p_brand", F.col("p_partkey").cast("string")).alias("path")),
    spark.createDataFrame([("root", "src"), ("economy", "src/ECONOMY"), ("deep", "src/ECONOMY/Brand#2"), ("other", "lib/x")], "service string, directory string"),
)
ORACLE_SQL["j10_service_of_files"] = "SELECT 'src/' || p_type || '/' || p_brand || '/' || p_partkey AS path, CASE WHEN p_type = 'ECONOMY' AND p_brand = 'Brand#2' THEN 'deep' WHEN p_type = 'ECONOMY' THEN 'economy' ELSE 'root' END AS service FROM part"
QUERIES["j11_codeowners"] = lambda spark, sf_dir: rs.owners_of_files(
    table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(".ts"))).alias("path")),
    [("*", ["@all"]), ("/ECONOMY/", ["@eco", "@two"]), ("*1.ts", ["@one"])],
)
ORACLE_SQL["j11_codeowners"] = """SELECT path, unnest(CASE WHEN ends_with(path, '1.ts') THEN ['@one'] WHEN starts_with(path, 'ECONOMY/') THEN ['@eco', '@two'] ELSE ['@all'] END) AS owner FROM (SELECT p_type || '/' || p_brand || '/' || p_partkey || '.ts' AS path FROM part)"""
