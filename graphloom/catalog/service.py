"""Facade, template and remaining operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.tables import JOBS, jobs
from graphloom.functions import text as tx
from graphloom.model import Graph
from graphloom.operators import graph as g
from graphloom.operators import search as se
from graphloom.operators import service as sv
from graphloom.operators import tables as t
from graphloom.plans.projection import star_graph, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *names: str):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def literal(name: str, columns: str, rows: list[tuple]):
    """Register f(spark) with its rows written out by hand."""
    def sql(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark)
        ORACLE_SQL[name] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql, r)) + ')' for r in rows)}) t({columns})"
        return f

    return register


def _small(spark) -> Graph:
    """A repository's graph with configuration, commits, tables and a cycle of services."""
    nodes = [
        ("s:pay", "Service", "pay-service", None), ("s:inv", "Service", "inv-service", None), ("s:ui", "Service", "ui", None), ("k:1", "ConfigKey", "PAY_URL", None), ("k:2", "SecretRef", "STRIPE_TOKEN", None),
        ("k:3", "ConfigKey", "OTHER", None), ("c:1", "Commit", "first", "2024-01-01"), ("c:2", "Commit", "second", "2024-02-01"), ("f:1", "File", "a.ts", None), ("f:2", "File", "b.ts", None),
        ("t:1", "Table", "users", None), ("t:2", "Table", "bills", None), ("col:1", "Column", "email", None), ("m:1", "Migration", "V2", None),
    ]
    edges = [
        ("s:pay", "k:1", "READS_CONFIG"), ("s:pay", "k:2", "USES_SECRET"), ("c:1", "f:1", "TOUCHED"), ("c:2", "f:1", "TOUCHED"), ("c:2", "f:2", "TOUCHED"), ("s:pay", "s:inv", "CALLS"),
        ("s:inv", "s:ui", "CALLS"), ("s:ui", "s:pay", "CALLS"), ("s:inv", "t:1", "OWNS"), ("s:pay", "t:2", "QUERIES"), ("t:1", "col:1", "HAS"), ("m:1", "t:2", "ALTERS"), ("s:ui", "s:pay", "USES"),
    ]
    return Graph(spark.createDataFrame(nodes, "id string, label string, name string, authored_at string"), spark.createDataFrame([(*e, None) for e in edges], "src string, dst string, type string, confidence string"))


@literal("g13_config_template", "id, label, name", [("k:1", "ConfigKey", "PAY_URL"), ("k:2", "SecretRef", "STRIPE_TOKEN"), ("k:3", "ConfigKey", "OTHER")])
def _(spark):
    return g.config_of(_small(spark), "pay-service", "other")


@literal("g15_commits_template", "\"commit\", name, authored_at, files", [("c:2", "second", "2024-02-01", "f:1,f:2"), ("c:1", "first", "2024-01-01", "f:1")])
def _(spark):
    graph = _small(spark)
    return g.commits_of(graph, graph.of("File").where("name in ('a.ts', 'b.ts')").select("id"))


@literal("g07b_column_impact", "id, label, name, distance", [("s:inv", "Service", "inv-service", 2)])
def _(spark):
    return g.typed_impact(_small(spark), "Column", "col:1")


@literal("g25_schema_drift", "id, label, owner", [("t:2", "Table", "m:1"), ("m:1", "Migration", None)])
def _(spark):
    graph = _small(spark)
    return g.schema_drift(graph.nodes.where("id not in ('t:2', 'm:1')"), graph)


@literal("j02_cyclic_paths", "path, depth", [("s:pay > s:inv", 1), ("s:pay > s:inv > s:ui", 2), ("s:pay > s:inv > s:ui > s:pay", 3), ("s:pay > s:inv > s:ui > s:pay", 3)])
def _(spark):
    from graphloom.plans.paths import expand, seeds_named

    graph = _small(spark)
    return expand(seeds_named(graph, "pay-service"), graph.between("CALLS", "USES"), 6).select(F.array_join("nodes", " > ").alias("path"), "depth")


@literal("g23_compare_dependencies", "name, side", [("inv-service", "overlap"), ("ghost", "runtime_only")])
def _(spark):
    declared = g.declared_dependencies(_small(spark), "pay-service").select("name")
    return g.compare_sets(declared, spark.createDataFrame([("inv-service",), ("ghost",)], "name string"), "name")


@literal("r06_execute_plan", "seed, owners", [("t:1", "inv-service"), ("t:2", "")])
def _(spark):
    graph = _small(spark)
    return sv.execute_plan(graph, "ownership", graph.of("Table").select(F.col("id").alias("seed")), "users", lambda: graph.nodes)[0]


@literal("v02_query_phrases", "phrases", [("user|a b|proficiency",)])
def _(spark):
    return spark.createDataFrame([("|".join(" ".join(p) for p in se.query_phrases('user* x "a-b" (proficiency)')),)], "phrases string")


@literal("v10_schema_keys", "keys", [("a,a.b,c,c.d",)])
def _(spark):
    text = '{"properties": {"a": {"properties": {"b": {}}}, "c": {"items": {"properties": {"d": {}}}}}}'
    return spark.createDataFrame([(text,), ("oops",)], "s string").select(F.array_join(sv.flatten_keys(F.col("s")), ",").alias("keys")).where("keys <> ''")


@literal("a15_diff_stats", "files, added, removed, new_files, deleted_files, renamed_files", [(2, 3, 1, 1, 0, 1)])
def _(spark):
    rows = [("a", "+++ b/a\n+x\n+y\n-z", True, False, False), ("b", "+q\n unchanged", False, False, True)]
    return sv.diff_stats(spark.createDataFrame(rows, "path string, diff string, new boolean, deleted boolean, renamed boolean"))


@literal("f13_join_paths", "p", [("/api/users",), ("/users",), ("/",)])
def _(spark):
    return spark.createDataFrame([("/api/", "/users"), ("", "users/"), ("/", "")], "a string, b string").select(tx.join_paths(F.col("a"), F.col("b")).alias("p"))


@literal("f27_placeholders", "u, tokens", [("{BILLING_API_URL}/v1/{id}", "billing,api")])
def _(spark):
    rows = spark.createDataFrame([("${BILLING_API_URL}/v1/${id}",)], "u string")
    words = F.filter(F.split(F.lower(F.regexp_extract("u", r"\$\{([A-Z_]+)\}", 1)), "_"), lambda w: ~w.isin("url", "host", "endpoint", ""))
    return rows.select(F.regexp_replace("u", r"\$\{(\w+)\}", "{$1}").alias("u"), F.array_join(words, ",").alias("tokens"))


@literal("p09_read_only_guard", "n", [(3,)])
def _(spark):
    spark.range(10).createOrReplaceTempView("guarded_ids")
    return sv.run_sql(spark, "SELECT id FROM guarded_ids -- all\n", 3).agg(F.count(F.lit(1)).alias("n"))


query("m09_save_snapshot", "SELECT o_orderpriority AS label, min(o_orderkey) AS id, max_by(o_orderstatus, o_orderkey) AS payload FROM orders GROUP BY 1", "orders")(
    lambda o: t.upsert(
        t.latest(o.select(F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("id"), F.lit("old").alias("payload")), ["label"], [F.asc("id")]),
        o.select(F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("payload"), F.col("o_orderkey").alias("seq")), ["label"], "seq", {"id": "keep_first"})
)
query("p03_multi_label", "SELECT count(*) AS n FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT c_custkey FROM customer UNION ALL SELECT r_regionkey FROM region)")(lambda: None)
QUERIES["p03_multi_label"] = lambda spark, sf_dir: star_graph(spark, sf_dir).of("Service", "Repo").agg(F.count(F.lit(1)).alias("n"))
query("a09_service_rollup", "SELECT DISTINCT n_nationkey AS service, l_partkey AS target, TRUE AS inferred FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_quantity > 40", "lineitem", "supplier")(
    lambda li, s: sv.rollup_services(li.where("l_quantity > 40").select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("target")), s.select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("service")))
)
query("u04_concat_matches", "SELECT doc_id FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id FROM documents WHERE source = 'src1'", "documents")(
    lambda d: d.where("lang = 'fr'").select("doc_id").unionByName(d.where("source = 'src1'").select("doc_id"))
)
query("f03_coalesce", f"SELECT id, coalesce(CASE WHEN status = 'FAILED' THEN repo_url END, '__none__') AS repo FROM {JOBS}", "events")(
    lambda e: jobs(e).select("id", F.coalesce(F.when(F.col("status") == "FAILED", F.col("repo_url")), F.lit("__none__")).alias("repo"))
)
query("f04_case", "SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 4 WHEN starts_with(p_name, 'red') THEN 3 WHEN contains(p_name, 'red') THEN 2 ELSE 1 END AS score FROM part", "part")(
    lambda p: p.select("p_partkey", F.when(F.col("p_name") == "red widget", 4).when(F.col("p_name").startswith("red"), 3).when(F.col("p_name").contains("red"), 2).otherwise(1).alias("score"))
)
query("f06_size_slice_unwind", "SELECT conv_id, unnest(list_slice(list(turn ORDER BY turn), 1, 2)) AS turn FROM conversations GROUP BY 1", "conversations")(
    lambda c: c.groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_list("turn")), 1, 2).alias("t")).select("conv_id", F.explode("t").alias("turn"))
)
query("f07_map_projection", "SELECT p_partkey, '{\"name\":\"' || p_name || '\",\"size\":' || p_size || '}' AS node FROM part", "part")(lambda p: p.select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("node")))
query("f11_template_match", r"SELECT page_id, len(s) = 2 AND lower(s[1]) = 'en' AS hit FROM (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages)", "pages")(
    lambda p: p.select("page_id", tx.template_matches(F.array(F.lit("en"), F.lit("{id}")), tx.segments(tx.url_path(F.col("url")))).alias("hit"))
)
query("f23_first_of", "SELECT event_id, CAST(coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS BIGINT) AS k FROM events", "events")(
    lambda e: e.select("event_id", sv.first_of(F.col("props"), "$.missing", "$.k").cast("long").alias("k"))
)
query("r17_fan_out", "SELECT s_nationkey, arg_max(s_suppkey, s_acctbal) AS s_suppkey FROM supplier WHERE s_acctbal > 0 GROUP BY 1", "supplier")(
    lambda s: s.where("s_acctbal > 0").groupBy("s_nationkey").agg(F.max_by("s_suppkey", "s_acctbal").alias("s_suppkey"))
)
query("t06_layer_cap", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_linenumber, l_orderkey, l_partkey LIMIT 800", "lineitem")(
    lambda li: li.orderBy("l_linenumber", "l_orderkey", "l_partkey").limit(800).select("l_orderkey", "l_linenumber")
)
query("z06_resume_jobs", f"SELECT id, CASE WHEN status = 'CLONING' THEN 'FAILED' ELSE status END AS status, status = 'PARSING' AS pending FROM {JOBS}", "events")(
    lambda e: jobs(e).select("id", F.when(F.col("status") == "CLONING", "FAILED").otherwise(F.col("status")).alias("status"), (F.col("status") == "PARSING").alias("pending"))
)
query("z08c_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1", "events")(
    lambda e: e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
)
