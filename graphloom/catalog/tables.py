"""Table operators over the driver tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.model import ERROR_CATEGORIES, clamp
from graphloom.operators import tables as t
from graphloom.plans.projection import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *names: str):
    """Register f(table, table, ...) over the named driver tables."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def jobs(events):
    """Ingestion jobs: one per event, repositories by user."""
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "view", "PENDING").when(F.col("event_type") == "click", "PARSING").otherwise("CLONING")
    return events.select(F.col("event_id").alias("id"), F.concat(F.lit("repo-"), "user_id").alias("repo_url"), status.alias("status"), F.col("ts").alias("started_at"), F.col("value"), F.get_json_object("props", "$.k").cast("long").alias("files"))


JOBS = """(SELECT event_id AS id, 'repo-' || user_id AS repo_url, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'PARSING' ELSE 'CLONING' END AS status,
  ts AS started_at, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS files FROM events)"""
ERROR = "CASE WHEN id % 7 < 3 THEN 'TIMEOUT' WHEN id % 7 < 5 THEN 'PARSE_FAILED' ELSE 'OOM' END"


@query("m01_merge_nodes", """SELECT 'Service' AS label, 'c' || coalesce(a.k, b.k) AS id, coalesce(b.name, a.name) AS name,
  concat_ws(',', CASE WHEN b.k IS NOT NULL THEN 'balance=' || CAST(CAST(b.c_acctbal AS BIGINT) AS VARCHAR) END, CASE WHEN a.k IS NOT NULL AND b.k IS NULL THEN 'nation=' || a.c_nationkey END, CASE WHEN a.k IS NOT NULL THEN 'segment=' || a.c_mktsegment END) AS props
  FROM (SELECT c_custkey AS k, c_name AS name, * FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k, upper(c_name) AS name, * FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k""", "customer")  # fmt: skip
def _(customer):
    base = customer.where("c_custkey % 3 <> 0").select(F.lit("Service").alias("label"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.create_map(F.lit("segment"), "c_mktsegment", F.lit("nation"), F.col("c_nationkey").cast("string")).alias("props"))
    new = customer.where("c_custkey % 2 = 0").select(F.lit("Service").alias("label"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.upper("c_name").alias("name"), F.create_map(F.lit("balance"), F.round("c_acctbal", 0).cast("long").cast("string"), F.lit("nation"), F.lit(None).cast("string")).alias("props"))
    line = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return t.merge_nodes(base, new).select("label", "id", "name", line.alias("props"))


ORACLE_SQL["m01_merge_nodes"] = ORACLE_SQL["m01_merge_nodes"].replace("CAST(b.c_acctbal AS BIGINT)", "CAST(round(b.c_acctbal, 0) AS BIGINT)")


@query("m02_merge_edges", """SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders)) AS attempted, (SELECT count(*) FROM orders JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 0) AS written""", "orders", "customer")
def _(orders, customer):
    nodes = customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("id")).unionByName(orders.where("o_orderkey % 3 <> 0").select(F.concat(F.lit("o"), "o_orderkey").alias("id")))
    new = orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit("CALLS").alias("type"), F.lit("HIGH").alias("confidence"), F.col("o_orderkey").alias("seq"))
    return t.merge_edges(new.limit(0), new, nodes)[1]


@query("m02b_merged_edges", """SELECT 'CALLS' AS type, 'c' || o_custkey AS src, o_orderpriority AS dst, max_by(o_orderstatus, o_orderkey) AS confidence FROM orders GROUP BY 1, 2, 3""", "orders")
def _(orders):
    new = orders.select(F.lit("CALLS").alias("type"), F.concat(F.lit("c"), "o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"), F.col("o_orderstatus").alias("confidence"), F.col("o_orderkey").alias("seq"))
    nodes = new.select(F.col("src").alias("id")).unionByName(new.select(F.col("dst").alias("id"))).distinct()
    return t.merge_edges(new.where("seq % 2 = 0").drop("seq").dropDuplicates(["type", "src", "dst"]), new, nodes)[0]


@query("m03_delete_files", "SELECT count(*) AS n_edges, count(DISTINCT o_custkey) AS n_src FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey % 4 <> 0", "orders", "customer")
def _(orders, customer):
    nodes = customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    edges = orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    gone = customer.where("c_custkey % 4 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("id")).unionByName(orders.where("o_orderkey % 5 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("id")))
    return t.delete_nodes(nodes, edges, gone)[1].agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_src"))


@query("m04_orphans", "SELECT 'c' || c_custkey AS id, 'File' AS label FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "customer", "orders")
def _(customer, orders):
    nodes = customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("File").alias("label"))
    return t.orphans(nodes, orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst")))


@query("m05_upsert", """SELECT coalesce(a.k, b.k) AS repo_url, coalesce(b.s, a.s) AS status, coalesce(b.v, a.v) AS value, coalesce(a.f, b.f) AS first_seen, CASE WHEN a.k IS NULL THEN b.e END AS error
  FROM (SELECT repo_url AS k, max_by(status, id) AS s, max_by(value, id) AS v, max_by(started_at, id) AS f FROM {jobs} WHERE id % 2 = 0 GROUP BY 1) a
  FULL JOIN (SELECT repo_url AS k, max_by(status, id) AS s, max_by(CASE WHEN status = 'FAILED' THEN -1 ELSE value END, id) AS v, max_by(started_at, id) AS f, max_by(status, id) AS e FROM {jobs} WHERE id % 2 = 1 AND id % 3 <> 0 GROUP BY 1) b ON a.k = b.k""".replace("{jobs}", JOBS).replace("max_by(CASE WHEN status = 'FAILED' THEN -1 ELSE value END, id) AS v", "NULLIF(max_by(CASE WHEN status = 'FAILED' THEN -1 ELSE value END, id), -1) AS v"), "events")  # fmt: skip
def _(events):
    j = jobs(events)
    base = t.latest(j.where("id % 2 = 0"), ["repo_url"], [F.desc("id")]).select("repo_url", "status", "value", F.col("started_at").alias("first_seen"), F.lit("old").alias("error"))
    new = j.where("id % 2 = 1 and id % 3 <> 0").select("repo_url", "status", F.when(F.col("status") != "FAILED", F.col("value")).alias("value"), F.col("started_at").alias("first_seen"), F.col("status").alias("error"), "id")
    rules = {"value": "coalesce", "first_seen": "keep_first", "error": "set_null"}
    return t.upsert(base, new, ["repo_url"], "id", rules).withColumn("error", F.when(F.col("error") != "old", F.col("error")))


@query("m06_fold_status", f"SELECT repo_url, max_by(status, id) AS status, max_by(CASE WHEN status IN ('COMPLETED', 'FAILED') THEN started_at END, id) FILTER (status IN ('COMPLETED', 'FAILED')) AS completed_at, max_by(files, id) FILTER (status = 'COMPLETED') AS files FROM {JOBS} GROUP BY 1", "events")
def _(events):
    j = jobs(events)
    done = j.select("repo_url", "id", "status", F.when(F.col("status").isin("COMPLETED", "FAILED"), F.col("started_at")).alias("completed_at"), F.when(F.col("status") == "COMPLETED", F.col("files")).alias("files"))
    return t.fold_status(done, "repo_url", "id", ["status", "completed_at", "files"])


@query("m07_replace_rows", f"SELECT repo_url, id FROM (SELECT repo_url, max(id) AS id FROM {JOBS} WHERE id % 3 = 0 AND id % 7 = 0 GROUP BY 1) UNION ALL SELECT repo_url, id FROM {JOBS} WHERE id % 3 <> 0 AND repo_url NOT IN (SELECT repo_url FROM {JOBS} WHERE id % 3 = 0 AND id % 7 = 0)", "events")
def _(events):
    j = jobs(events).select("repo_url", "id")
    return t.replace_rows(j.where("id % 3 <> 0"), j.where("id % 3 = 0 and id % 7 = 0"), "repo_url", "id")


@query("m08_delete_retention", f"SELECT id, repo_url FROM {JOBS} WHERE NOT (started_at < TIMESTAMP '2024-01-15' AND status IN ('FAILED', 'COMPLETED'))", "events")
def _(events):
    gone = (F.col("started_at") < F.lit("2024-01-15").cast("timestamp_ntz")) & F.col("status").isin("FAILED", "COMPLETED")
    return t.delete_where(jobs(events), gone).select("id", "repo_url")


@query("m10_mark_resolved", "SELECT event_id AS id, CASE WHEN user_id % 10 = 0 THEN TIMESTAMP '2024-02-01' END AS resolved_at FROM events WHERE event_type = 'error'", "events")
def _(events):
    return events.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 10 == 0, F.lit("2024-02-01").cast("timestamp_ntz")).alias("resolved_at"))


@query("m11_feedback_insert", "SELECT doc_id AS trace_id, CASE quality WHEN 1 THEN 'up' WHEN 0 THEN 'down' END AS verdict FROM labels WHERE quality IN (0, 1)", "labels")
def _(labels):
    verdict = F.when(F.col("quality") == 1, "up").when(F.col("quality") == 0, "down")
    return labels.select(F.col("doc_id").alias("trace_id"), verdict.alias("verdict")).where(F.col("verdict").isin("up", "down"))


@query("m13_embed_skip", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1)", "documents")
def _(documents):
    hashed = documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return hashed.where("doc_id % 2 = 0").join(hashed.where("doc_id % 2 = 1").select("content_hash"), "content_hash", "left_anti").select("doc_id")


@query("m14_invalidate", "SELECT vec_id, CAST(label AS VARCHAR) AS label FROM embeddings WHERE label NOT IN (1, 3, 5)", "embeddings")
def _(embeddings):
    return t.delete_where(embeddings, F.col("label").isin(1, 3, 5)).select("vec_id", F.col("label").cast("string").alias("label"))


query("p01_projection", "SELECT p_name AS name, 'API' AS label, 'size=' || p_size || ',brand=' || p_brand AS props FROM part", "part")(
    lambda part: part.select(F.col("p_name").alias("name"), F.lit("API").alias("label"), F.concat(F.lit("size="), "p_size", F.lit(",brand="), "p_brand").alias("props"))
)
query("p02_case_folded", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR starts_with(lower(p_brand), 'brand#2') OR lower(p_type) = 'economy'", "part")(
    lambda part: part.where(F.contains(F.lower("p_name"), F.lit("ring")) | F.lower("p_brand").startswith("brand#2") | (F.lower("p_type") == "economy")).select("p_partkey")
)
query("p05_is_null", f"SELECT id FROM {JOBS} WHERE CASE WHEN status = 'FAILED' THEN value END IS NULL AND repo_url IS NOT NULL", "events")(
    lambda events: jobs(events).where(F.when(F.col("status") == "FAILED", F.col("value")).isNull() & F.col("repo_url").isNotNull()).select("id")
)
query("p06_in_list", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('machinery', 'building')", "customer")(
    lambda customer: customer.where(F.lower("c_mktsegment").isin("machinery", "building")).select("c_custkey")
)
query("p07_time_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'", "events")(
    lambda events: events.where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz"))).select("event_id")
)
query("p08_dynamic_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src3'", "documents")(
    lambda documents: conjunction(documents, lang="en", source="src3", n_chars=None).select("doc_id")
)


def conjunction(df, **wanted):
    """Rows that equal every given value; a value of None asks nothing."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


query("s14_point_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 42", "orders")(lambda orders: orders.where("o_orderkey = 42").select("o_orderkey", "o_custkey").limit(1))
query("j03_optional_match", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'", "customer", "orders")(
    lambda customer, orders: customer.join(orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")
)
query("j05_or_join", "SELECT s_suppkey, coalesce((SELECT n_name FROM nation WHERE n_nationkey = s_nationkey AND s_suppkey % 2 = 0), (SELECT n_name FROM nation WHERE n_name = 'NATION_' || (s_suppkey % 25))) AS nation FROM supplier", "supplier", "nation")(
    lambda supplier, nation: supplier.withColumns({"by_id": F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")), "by_name": F.concat(F.lit("NATION_"), F.col("s_suppkey") % 25)})
    .join(nation.select(F.col("n_nationkey").alias("by_id"), F.col("n_name").alias("a")), "by_id", "left")
    .join(nation.select(F.col("n_name").alias("by_name"), F.col("n_name").alias("b")), "by_name", "left").select("s_suppkey", F.coalesce("a", "b").alias("nation"))
)
query("j07_latest_failed", f"SELECT j.id, j.repo_url FROM {JOBS} j JOIN (SELECT repo_url, max(started_at) AS m FROM {JOBS} GROUP BY 1) x ON x.repo_url = j.repo_url AND x.m = j.started_at WHERE j.status = 'FAILED'", "events")(
    lambda events: (lambda j: j.join(j.groupBy("repo_url").agg(F.max("started_at").alias("started_at")), ["repo_url", "started_at"]).where("status = 'FAILED'").select("id", "repo_url"))(jobs(events))
)
query("j07b_latest_job", f"SELECT repo_url, max_by(id, started_at) AS id FROM {JOBS} GROUP BY 1", "events")(
    lambda events: t.latest(jobs(events), ["repo_url"], [F.desc("started_at"), F.desc("id")]).select("repo_url", "id")
)
query("j13_has_rollup", "SELECT p_brand AS name, string_agg(p_name || ':' || p_partkey, ',' ORDER BY p_partkey) AS columns FROM part WHERE p_size > 45 GROUP BY 1", "part")(
    lambda part: part.where("p_size > 45").groupBy(F.col("p_brand").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: F.concat_ws(":", s["p_name"], s["p_partkey"].cast("string"))), ",").alias("columns"))
)
query("j14_hash_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", "customer", "orders")(
    lambda customer, orders: customer.join(orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")
)
query("a03_zero_fill", f"SELECT c AS category, coalesce(n, 0) AS n FROM (SELECT unnest({list(ERROR_CATEGORIES)}) AS c) LEFT JOIN (SELECT {ERROR} AS e, count(*) AS n FROM {JOBS} WHERE status = 'FAILED' GROUP BY 1) ON e = c", "events")(
    lambda events: t.zero_filled(jobs(events).where("status = 'FAILED'").groupBy(F.expr(ERROR).alias("category")).agg(F.count(F.lit(1)).alias("n")), "category", ERROR_CATEGORIES)
)
query("a04_verdict_counts", "SELECT count(*) FILTER (quality = 1) AS up, count(*) FILTER (quality = 0) AS down FROM labels", "labels")(
    lambda labels: labels.agg(F.count_if(F.col("quality") == 1).alias("up"), F.count_if(F.col("quality") == 0).alias("down"))
)
query("a05_collect_distinct", "SELECT c_nationkey AS nation, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1", "customer")(
    lambda customer: customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))
)
_P = "list_sort(list(value))[least(count(*), CAST(floor({} * count(*)) AS BIGINT) + 1)]"
query("a10_histogram_summary", f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, {_P.format(0.5)} AS p50, {_P.format(0.95)} AS p95, {_P.format(0.99)} AS p99 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 1024 GROUP BY 1", "events")(
    lambda events: t.reservoir(events, "event_type", "value", "event_id")
)
query("w03_last_n", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 100", "events")(
    lambda events: events.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id")))).where("r <= 100").select("event_type", "event_id")
)
query("a11_labelled_counters", "SELECT 'events{kind=' || event_type || ',odd=' || (user_id % 2) || '}' AS key, count(*) AS n, max_by(value, event_id) AS gauge FROM events GROUP BY 1", "events")(
    lambda events: events.groupBy(F.concat(F.lit("events{kind="), "event_type", F.lit(",odd="), (F.col("user_id") % 2).cast("string"), F.lit("}")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max_by("value", "event_id").alias("gauge"))
)
query("a16_error_groups", "SELECT user_id AS service, event_type AS message, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE event_type = 'error' GROUP BY 1, 2", "events")(
    lambda events: events.where("event_type = 'error'").groupBy(F.col("user_id").alias("service"), F.col("event_type").alias("message")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
)
query("a17_freshness", "SELECT count(*) AS total, count(*) FILTER (m >= TIMESTAMP '2024-01-29') AS fresh, count(*) FILTER (m < TIMESTAMP '2024-01-29') AS stale, max(m) AS last_updated FROM (SELECT user_id, max(ts) AS m FROM events GROUP BY 1)", "events")(
    lambda events: events.groupBy("user_id").agg(F.max("ts").alias("m")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("m") >= F.lit("2024-01-29").cast("timestamp_ntz")).alias("fresh"),
        F.count_if(F.col("m") < F.lit("2024-01-29").cast("timestamp_ntz")).alias("stale"), F.max("m").alias("last_updated"))
)
query("a18_group_by_depth", "SELECT 'depth_' || l_linenumber AS depth, count(*) AS n, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS names FROM lineitem GROUP BY 1", "lineitem")(
    lambda lineitem: lineitem.groupBy(F.concat(F.lit("depth_"), "l_linenumber").alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("names"))
)
query("a19_distinct_labels", "SELECT DISTINCT lang FROM documents", "documents")(lambda documents: documents.select("lang").distinct().orderBy("lang"))
query("a20_first_wins", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1", "documents")(
    lambda documents: t.latest(documents.select("source", "doc_id"), ["source"], [F.asc("doc_id")])
)
query("a21_progress", f"SELECT repo_url, count(*) FILTER (status IN ('COMPLETED', 'FAILED')) || '/' || count(*) AS progress FROM {JOBS} GROUP BY 1", "events")(
    lambda events: jobs(events).groupBy("repo_url").agg(F.concat_ws("/", F.count_if(F.col("status").isin("COMPLETED", "FAILED")).cast("string"), F.count(F.lit(1)).cast("string")).alias("progress"))
)
query("w01_rank_in_list", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents", "documents")(
    lambda documents: documents.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
)
query("w02_latest_per_key", "SELECT user_id, max_by(event_id, ts) AS event_id FROM events GROUP BY 1", "events")(
    lambda events: t.latest(events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")
)
query("w04_last_changed", "SELECT l_partkey AS path, max(l_shipdate) AS last_changed FROM lineitem GROUP BY 1", "lineitem")(
    lambda lineitem: lineitem.groupBy(F.col("l_partkey").alias("path")).agg(F.max("l_shipdate").alias("last_changed"))
)
query("w06_running_state", f"SELECT id, last_value(CASE WHEN status = 'COMPLETED' THEN files END IGNORE NULLS) OVER (PARTITION BY repo_url ORDER BY id ROWS UNBOUNDED PRECEDING) AS files FROM {JOBS}", "events")(
    lambda events: jobs(events).select("id", F.last(F.when(F.col("status") == "COMPLETED", F.col("files")), ignorenulls=True).over(Window.partitionBy("repo_url").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)).alias("files"))
)
query("t01_sort_limit", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 20", "customer")(
    lambda customer: customer.orderBy(F.desc("c_acctbal"), "c_name").limit(clamp(20, 1, 100)).select("c_custkey", "c_name")
)
query("t07_locale_sort", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey) AS pos FROM part", "part")(
    lambda part: part.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.collate("p_name", "UNICODE"), "p_partkey")).alias("pos"))
)
query("t08_list_slice", f"SELECT id FROM {JOBS} WHERE status = 'FAILED' ORDER BY started_at DESC, id LIMIT 10", "events")(
    lambda events: jobs(events).where("status = 'FAILED'").orderBy(F.desc("started_at"), "id").limit(10).select("id")
)
query("u01_union_distinct", "SELECT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity > 45 UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_discount > 0.08", "lineitem")(
    lambda lineitem: (lambda x: x(lineitem.where("l_quantity > 45")).unionByName(x(lineitem.where("l_discount > 0.08"))).distinct())(lambda d: d.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))
)
query("u02_union_all", "SELECT 'q' AS kind, l_orderkey AS k FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT 'd', l_orderkey FROM lineitem WHERE l_discount > 0.08", "lineitem")(
    lambda lineitem: lineitem.where("l_quantity > 45").select(F.lit("q").alias("kind"), F.col("l_orderkey").alias("k")).unionByName(lineitem.where("l_discount > 0.08").select(F.lit("d").alias("kind"), F.col("l_orderkey").alias("k")))
)
query("u03_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'", "customer", "orders")(
    lambda customer, orders: customer.select("c_custkey").subtract(orders.where("o_orderstatus = 'O'").select("o_custkey"))
)
query("u03b_intersection", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'", "customer", "orders")(
    lambda customer, orders: customer.select("c_custkey").intersect(orders.where("o_orderstatus = 'O'").select("o_custkey"))
)
query("u05_local_then_remote", "SELECT s_suppkey AS id, 0 AS src_rank FROM supplier UNION ALL SELECT c_custkey, 1 FROM customer", "supplier", "customer")(
    lambda supplier, customer: supplier.select(F.col("s_suppkey").alias("id"), F.lit(0).alias("src_rank")).unionByName(customer.select(F.col("c_custkey").alias("id"), F.lit(1).alias("src_rank")))
)
query("r15_list_dlq", f"SELECT id, repo_url, {ERROR} AS category FROM {JOBS} WHERE status = 'FAILED' AND {ERROR} = 'TIMEOUT' ORDER BY started_at DESC, id LIMIT 50", "events")(
    lambda events: jobs(events).where("status = 'FAILED'").withColumn("category", F.expr(ERROR)).where("category = 'TIMEOUT'").orderBy(F.desc("started_at"), "id").limit(50).select("id", "repo_url", "category")
)
query("r20_retry_selection", f"SELECT id, repo_url FROM {JOBS} WHERE status = 'FAILED' AND {ERROR} IN ('TIMEOUT', 'OOM') AND id % 10 <> 0", "events")(
    lambda events: jobs(events).where("status = 'FAILED'").where(F.expr(ERROR).isin("TIMEOUT", "OOM") & (F.col("id") % 10 != 0)).select("id", "repo_url")
)
query("r23_feedback_list", "SELECT doc_id FROM labels WHERE quality = 0 ORDER BY doc_id DESC LIMIT 1000", "labels")(lambda labels: labels.where("quality = 0").orderBy(F.desc("doc_id")).limit(1000).select("doc_id"))
query("r21_trace_fold", "SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles, max_by(length(text), turn) AS last_length FROM conversations GROUP BY 1", "conversations")(
    lambda conversations: conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ",").alias("roles"), F.max_by(F.length("text").cast("long"), "turn").alias("last_length"))
)
query("f22_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", "events")(
    lambda events: events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))
)
query("f21_dates", "SELECT event_id, date_trunc('day', ts) AS day, date_diff('minute', TIMESTAMP '2024-01-01', ts) AS minute FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY", "events")(
    lambda events: events.where(F.col("ts") >= F.expr("timestamp_ntz'2024-01-31' - interval 14 days")).select("event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60 - F.lit(28401120)).alias("minute"))
)
query("z08_tumbling", "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2", "events")(
    lambda events: events.groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
)
query("z08b_sessions", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""", "events")(
    lambda events: events.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).select("user_id", "start", "n")
)
