"""Configuration scans, merge requests, blamed ranges, validation and the router's fallback over whole driver tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.search import _Q, _class_sql
from graphloom.operators import changes as ch
from graphloom.operators import config_scan as cs
from graphloom.operators import router as r
from graphloom.operators import validation as v
from graphloom.plans.projection import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str, *names: str):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
        ORACLE_SQL[name] = sql
        return f

    return register


def _config_files(supplier):
    """A repository a supplier with one file: dotenv, JSON (each fifth broken), compose, or a dotenv file below a folder."""
    scheme = F.element_at(F.array(*map(F.lit, ("mongodb+srv", "POSTGRES", "mysql", "redis", "couchbase", "amqp", "mssql", "kafka"))), (F.col("s_suppkey") % 8 + 1).cast("int"))
    env = F.concat(F.lit("# redis://off\n\n  DATABASE_URL = '"), scheme, F.lit("://h/x'\r\nREDIS_HOST=cache\nDB_HOST=pg\nno assignment\nNAME="), "s_name")
    tree = F.concat(F.lit('{"a": {"mysql://key" : 1, "list": ["\\"x\\"", "'), scheme, F.lit(':\\/\\/h"]}, "n": null'), F.when(F.col("s_nationkey") % 5 != 0, "}").otherwise(""))
    compose = F.concat(F.lit('services:\n  a: {image: postgres:15}\n  b:\n    image: "redis"\n'), F.when(F.col("s_nationkey") % 3 == 0, "  c:\n    Image: 'Neo4j'\n").otherwise("x: nothing\n"))
    kind = (F.floor(F.col("s_suppkey") / 8) % 4).cast("int")
    path = F.element_at(F.array(*map(F.lit, (".env", "config/app.JSON", "docker-compose.yml", "src/.env"))), kind + 1)
    return supplier.select(F.col("s_name").alias("repo_url"), path.alias("path"), F.when(kind == 1, tree).when(kind == 2, compose).otherwise(env).alias("content"))


_KIND = "(s_suppkey // 8) % 4"
_TYPE = "[ 'MongoDB', 'PostgreSQL', 'MySQL', 'Redis', 'Couchbase', 'RabbitMQ', 'MSSQL', NULL ][s_suppkey % 8 + 1]"
query("s05_config_databases", f"""SELECT s_name AS repo_url, path, database, 'config_file' AS detected_via, path.split('/')[-1] AS package_name FROM (
  SELECT DISTINCT s_name, '.env' AS path, unnest([{_TYPE}, 'Redis']) AS database FROM supplier WHERE {_KIND} = 0
  UNION ALL SELECT s_name, 'config/app.JSON', {_TYPE} FROM supplier WHERE {_KIND} = 1 AND s_nationkey % 5 <> 0
  UNION ALL SELECT s_name, 'docker-compose.yml', unnest(['PostgreSQL', 'Redis', CASE WHEN s_nationkey % 3 = 0 THEN 'Neo4j' END]) FROM supplier WHERE {_KIND} = 2) WHERE database IS NOT NULL""", "supplier")(
    lambda supplier: cs.config_databases(_config_files(supplier))
)
query("s05b_config_variables", f"""SELECT s_name AS repo_url, unnest(['DATABASE_URL', 'REDIS_HOST', 'DB_HOST', 'NAME']) AS key, unnest([{_TYPE}, 'Redis', NULL, NULL]) AS database,
  unnest([TRUE, TRUE, TRUE, FALSE]) AS is_database_related FROM supplier WHERE {_KIND} = 0""", "supplier")(
    lambda supplier: cs.config_variables(_config_files(supplier)).select("repo_url", "key", "database", "is_database_related")
)

_RULES = {"p_name": v.Field(required=True, least_length=10), "p_type": v.Field(choices=("ECONOMY", "STANDARD")), "p_size": v.Field(int, low=5, high=40), "p_brand": v.Field(most_length=7)}
query("r22_violations", """SELECT p_partkey, array_to_string(list_filter([
    CASE WHEN p_name IS NULL THEN 'p_name: required' WHEN length(p_name) < 10 THEN 'p_name: too short' END,
    CASE WHEN p_type NOT IN ('ECONOMY', 'STANDARD') THEN 'p_type: not a choice' END,
    CASE WHEN p_size < 5 THEN 'p_size: too small' WHEN p_size > 40 THEN 'p_size: too large' END,
    CASE WHEN length(p_brand) > 7 THEN 'p_brand: too long' END], lambda x: x IS NOT NULL), '; ') AS problems
  FROM part WHERE p_name IS NULL OR length(p_name) < 10 OR p_type NOT IN ('ECONOMY', 'STANDARD') OR p_size < 5 OR p_size > 40 OR length(p_brand) > 7""", "part")(
    lambda part: v.violations(part, _RULES).select("p_partkey", F.array_join("problems", "; ").alias("problems"))
)

_TURNS = _class_sql().replace(_Q, "(SELECT DISTINCT text AS q FROM conversations WHERE role = 'user')")
query("r07_asks_model", f"""SELECT conv_id, turn, CASE WHEN confidence < 0.4 AND turn % 3 = 0 THEN 'code' ELSE class END AS class, confidence < 0.4 AS asks_model
  FROM conversations JOIN ({_TURNS}) ON text = q WHERE role = 'user'""", "conversations")(
    lambda c: r.with_model_answers(
        r.with_fallback(r.classify(c.where("role = 'user'").withColumn("key", F.concat_ws(":", "conv_id", "turn")), "text")),
        c.where("role = 'user' and turn % 3 = 0").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.explode(F.array(F.lit("code"), F.lit("nonsense"))).alias("class"), F.lit(0.9).alias("confidence")), "key",
    ).select("conv_id", "turn", "class", "asks_model")
)

_LINES = "SELECT o_custkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, o_orderstatus AS sha FROM orders"
query("f30_blame_ranges", f"""SELECT path, first, last, min(line) AS from_line, max(line) AS to_line, sha, 'by ' || sha AS author
  FROM (SELECT *, line - row_number() OVER (PARTITION BY path, first, last, sha ORDER BY line) AS island FROM ({_LINES})
        JOIN (SELECT c_custkey AS path, c_custkey % 5 AS first, c_custkey % 7 + 2 AS last FROM customer) USING (path) WHERE line BETWEEN first AND last)
  GROUP BY path, first, last, sha, island""", "orders", "customer")(
    lambda orders, customer: ch.blame_ranges(
        orders.selectExpr("o_custkey as path", "cast(row_number() over (partition by o_custkey order by o_orderkey) as long) as line", "o_orderstatus as sha", "concat('by ', o_orderstatus) as author"),
        customer.selectExpr("c_custkey as path", "c_custkey % 5 as first", "c_custkey % 7 + 2 as last"),
    )
)

_FOLDERS = ("db/migrations/", "Charts/a/", "K8s/", ".github/workflows/", "Dockerfile.", "infra/main.tf", "vault/", "src/", "deploy/migration/")


def _churn(lineitem):
    """A supplier's line items as the changed files of one merge request."""
    folder = F.element_at(F.array(*map(F.lit, _FOLDERS)), (F.col("l_partkey") % 9 + 1).cast("int"))
    path = F.when(folder.endswith(".tf"), folder).otherwise(F.concat(folder, F.concat_ws("-", "l_orderkey", "l_linenumber")))
    diff = F.concat(F.lit("--- a\n+++ b\n"), F.repeat(F.lit("+new\n"), F.col("l_linenumber")), F.repeat(F.lit("-old\n"), (F.col("l_quantity") % 4).cast("int")), F.lit(" same"))
    return ch.file_churn(lineitem.select(F.col("l_suppkey").alias("mr"), path.alias("path"), diff.alias("diff")))


_TAGS = "[['migration'], ['helm'], ['k8s'], ['ci'], ['dockerfile'], ['terraform'], ['secrets'], [], ['migration', 'helm']][l_partkey % 9 + 1]"
_CHURN_SQL = f"""SELECT l_suppkey AS mr, l_linenumber AS added, CAST(l_quantity % 4 AS INT) AS removed, {_TAGS} AS tags,
  CASE WHEN l_partkey % 9 = 5 THEN 'infra/main.tf' ELSE [{', '.join(f"'{f}'" for f in _FOLDERS)}][l_partkey % 9 + 1] || l_orderkey || '-' || l_linenumber END AS path FROM lineitem"""
query("a15b_tag_counts", f"SELECT mr, tag, count(*) AS files FROM (SELECT mr, unnest(tags) AS tag FROM ({_CHURN_SQL})) GROUP BY ALL", "lineitem")(lambda lineitem: ch.tag_counts(_churn(lineitem)))
query("a15c_top_files", f"SELECT mr, place, path, added + removed AS churn FROM (SELECT *, row_number() OVER (PARTITION BY mr ORDER BY added + removed DESC, path) AS place FROM ({_CHURN_SQL})) WHERE place <= 15", "lineitem")(
    lambda lineitem: ch.top_files(_churn(lineitem)).select("mr", "place", "path", (F.col("added") + F.col("removed")).alias("churn"))
)
_TOUCHES = ", ".join(
    f"CASE WHEN count(*) FILTER (list_contains(tags, '{t}')) > 0 THEN 'touches {t} (' || count(*) FILTER (list_contains(tags, '{t}')) || CASE WHEN count(*) FILTER (list_contains(tags, '{t}')) > 1 THEN ' files)' ELSE ' file)' END END"
    for t, _ in ch.RISK_PATHS
)
query("a15d_merge_risks", f"""SELECT s_suppkey AS mr, array_to_string(list_filter(list_concat(
    [CASE WHEN files > 50 THEN 'large MR: ' || files || ' files changed' END, CASE WHEN plus + minus > 1500 THEN 'large diff: +' || plus || '/-' || minus || ' lines' END,
     CASE WHEN s_suppkey % 2 = 0 THEN 'draft' END, CASE WHEN s_suppkey % 3 = 0 THEN 'has merge conflicts' END, CASE WHEN s_suppkey % 5 = 0 THEN 'latest pipeline status=failed' END,
     CASE WHEN s_suppkey % 4 IN (1, 2) THEN 'approvals_left=' || s_suppkey % 4 END, CASE WHEN s_suppkey % 4 = 0 THEN 'no approvers yet' END],
    touches, [CASE WHEN s_suppkey % 7 = 0 THEN 'description mentions "breaking change"' WHEN s_suppkey % 7 = 1 THEN 'description mentions "!:"' END]), lambda x: x IS NOT NULL), '; ') AS risks
  FROM supplier LEFT JOIN (SELECT mr, count(*) AS files, sum(added) AS plus, sum(removed) AS minus, [{_TOUCHES}] AS touches FROM ({_CHURN_SQL}) GROUP BY mr) ON mr = s_suppkey""", "supplier", "lineitem")(
    lambda supplier, lineitem: ch.merge_risks(
        supplier.selectExpr(
            "s_suppkey as mr", "case when s_suppkey % 7 = 1 then 'feat!: new' else 'Title' end as title", "case when s_suppkey % 7 = 0 then 'A BREAKING change, !: said' end as description",
            "s_suppkey % 2 = 0 as draft", "s_suppkey % 3 = 0 as has_conflicts", "case when s_suppkey % 5 = 0 then 'failed' when s_suppkey % 5 = 1 then 'success' end as pipeline",
            "case when s_suppkey % 4 < 3 then s_suppkey % 4 end as approvals_left", "case when s_suppkey % 4 < 3 then s_suppkey % 4 end as approvers",
        ), _churn(lineitem),
    ).select("mr", F.array_join("risks", "; ").alias("risks"))
)
