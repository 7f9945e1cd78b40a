"""Extraction and streaming operators over inline source files and the driver tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import extract as x
from graphloom.operators import typescript as ts
from graphloom.plans.projection import table
from graphloom.sources import files as src
from graphloom.streaming import events as ev

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TS = """import express from 'express';
import './local';
const pg = require('pg');
import { Kafka } from 'kafkajs';
const url = process.env.BILLING_URL;
app.get('/users/:id', handler);
@Post('orders')
axios.post('https://billing-api/v1/invoices', body);
fetch('/health');
producer.send({ topic: 'orders.created' });
consumer.subscribe({ topic: 'orders.paid' });
"""
PY = """import os
from flask import Flask
import psycopg2
KEY = os.environ.get("API_KEY")

class Store:
    def load(self, k):
        return k

    async def save(self, k):
        if k:
            return requests.get("http://inventory/items")

@app.route('/items', methods=['POST'])
def create():
    pass
"""
GO = """package main
import "github.com/lib/pq"
type UserProfile struct {
  ID int `gorm:"primaryKey"`
}
func main() { r.GET("/ping", f); os.Getenv("PORT") }
"""
DDL = """CREATE TABLE users (id BIGINT PRIMARY KEY, email VARCHAR(255) NOT NULL, age INT);
create table if not exists orders (id int, user_id int not null, total numeric(10, 2), primary key (id, user_id));
ALTER TABLE users ADD COLUMN x int; DROP TABLE IF EXISTS old_t;
"""
PRISMA = """model User {
  id    Int     @id @default(autoincrement())
  email String? @unique
  posts Post[]
}
enum Role {
  ADMIN
}
"""
MD = """# Title
text [a](http://x) and [b](y.md)
```sh
# no heading
```
Section
-------
## Sub ##
"""
ENV = """# comment
export HOST="local host" # c
API_TOKEN=abc # tail
PORT=80
"""
OWNERS = """* @all
/src/ @org/core dev@x.io # note
# only a comment
"""
YAML = """server:
  port: 8080
  list: [a, b]
db:
  password: "${DB_PASS:none}"
variables:
  CI_TOKEN: t
"""
API = """openapi: 3.0.0
paths:
  /users/{id}:
    get: {operationId: getUser}
    delete: {}
"""
PROTO = """service Billing {
  rpc Charge (A) returns (B);
  rpc Refund (A) returns (B);
}
"""
GQL = """type Query {
  user(id: ID): User
  all: [User]
}
"""
XML = """<createTable tableName="acc"><column name="id" type="int"/><column name="n" type="varchar(9)"></column></createTable>"""
ORM = """__tablename__ = 'invoices'
class Customer(models.Model):
    pass
"""
FILES = {
    "src/app.ts": TS, "svc/store.py": PY, "cmd/main.go": GO, "db/V1__init.sql": DDL, "db/schema.prisma": PRISMA, "README.md": MD, ".env.example": ENV, "CODEOWNERS": OWNERS,
    "conf/app.yml": YAML, "api/openapi.yaml": API, "api/billing.proto": PROTO, "api/q.graphql": GQL, "db/changelog.xml": XML, "svc/models.py": ORM, "svc/package.json": "{}", "web/package.json": "{}",
}


def _files(spark):
    return spark.createDataFrame([("r", p, c) for p, c in FILES.items()], "repo_url string, path string, content string")


def golden(name: str, f, columns: str, rows: list[tuple]):
    """Register f(files) over the inline files with its rows written out by hand."""
    def sql(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    QUERIES[name] = lambda spark, sf_dir: f(_files(spark))
    ORACLE_SQL[name] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql, r)) + ')' for r in rows)}) t({columns})"


golden("x01_imports", lambda f: x.imports(f).drop("repo_url"), "path, source, is_local", [
    ("src/app.ts", "express", False), ("src/app.ts", "./local", True), ("src/app.ts", "pg", False), ("src/app.ts", "kafkajs", False), ("svc/store.py", "os", False),
    ("svc/store.py", "flask", False), ("svc/store.py", "psycopg2", False), ("cmd/main.go", "github.com/lib/pq", False)])
golden("x02_routes", lambda f: x.routes(f).drop("repo_url"), "path, method, route", [("src/app.ts", "GET", "/users/:id"), ("src/app.ts", "POST", "/orders"), ("svc/store.py", "POST", "/items"), ("cmd/main.go", "GET", "/ping")])
golden("x03_http_calls", lambda f: x.http_calls(f).drop("repo_url"), "path, method, url, is_template", [("src/app.ts", "POST", "https://billing-api/v1/invoices", False), ("src/app.ts", "GET", "/health", False), ("svc/store.py", "GET", "http://inventory/items", False)])
golden("x04_database_uses", lambda f: x.database_uses(f).drop("repo_url"), "path, source, \"database\"", [("src/app.ts", "pg", "PostgreSQL"), ("svc/store.py", "psycopg2", "PostgreSQL"), ("cmd/main.go", "github.com/lib/pq", "PostgreSQL")])
golden("x05_env_vars", lambda f: x.env_vars(f).drop("repo_url"), "path, name", [("src/app.ts", "BILLING_URL"), ("svc/store.py", "API_KEY"), ("cmd/main.go", "PORT")])
golden("x06_topics", lambda f: x.topics(f).drop("repo_url"), "path, kind, topic", [("src/app.ts", "produce", "orders.created"), ("src/app.ts", "consume", "orders.paid")])
golden("x11_import_edges", lambda f: x.import_edges(f).where("type in ('USES', 'READS_CONFIG', 'PRODUCES', 'CONSUMES')"), "src, dst, type", [
    ("r:src/app.ts", "db:postgresql", "USES"), ("r:svc/store.py", "db:postgresql", "USES"), ("r:cmd/main.go", "db:postgresql", "USES"), ("r:src/app.ts", "config:env:BILLING_URL", "READS_CONFIG"),
    ("r:svc/store.py", "config:env:API_KEY", "READS_CONFIG"), ("r:cmd/main.go", "config:env:PORT", "READS_CONFIG"), ("r:src/app.ts", "topic:orders.created", "PRODUCES"), ("r:src/app.ts", "topic:orders.paid", "CONSUMES")])
golden("x22_headings", lambda f: x.headings(f.where("path like '%.md'")).drop("repo_url"), "path, level, text, line", [("README.md", 1, "Title", 1), ("README.md", 2, "Section", 6), ("README.md", 2, "Sub", 8)])
golden("x22b_doc_stats", lambda f: x.doc_stats(f.where("path like '%.md'")).drop("repo_url"), "path, kind, code_blocks, links", [("README.md", "readme", 1, 2)])
golden("x25_dotenv", lambda f: x.dotenv(f.where("path like '%.env%'")).drop("repo_url"), "path, line, key, value, is_secret", [(".env.example", 2, "HOST", "local host", False), (".env.example", 3, "API_TOKEN", "abc", True), (".env.example", 4, "PORT", "80", False)])
golden("x30_codeowners", lambda f: x.codeowners(f.where("path = 'CODEOWNERS'")).select("seq", "pattern", F.array_join("owners", " ").alias("owners")), "seq, pattern, owners", [(0, "*", "@all"), (1, "/src/", "@org/core dev@x.io")])
golden("x13_owner_nodes", lambda f: x.owner_nodes(x.codeowners(f.where("path = 'CODEOWNERS'"))), "id, identifier, kind", [("owner:all", "@all", "user"), ("team:org/core", "@org/core", "team"), ("owner:dev@x.io", "dev@x.io", "email")])
golden("x17_prisma", lambda f: x.prisma_fields(f).drop("repo_url", "path"), "\"table\", \"column\", type, nullable, is_primary, is_list", [("User", "id", "Int", False, True, False), ("User", "email", "String", True, False, False), ("User", "posts", "Post", False, False, True)])
golden("x15_ddl_columns", lambda f: x.ddl_columns(f.where("path like '%.sql'")).drop("repo_url", "path"), "\"table\", \"column\", type, nullable, is_primary", [
    ("users", "id", "bigint", False, True), ("users", "email", "varchar(255)", False, False), ("users", "age", "int", True, False), ("orders", "id", "int", False, True),
    ("orders", "user_id", "int", False, True), ("orders", "total", "numeric(10, 2)", True, False)])
golden("x15b_ddl_changes", lambda f: x.ddl_changes(f.where("path like '%.sql'")).drop("repo_url", "path"), "operation, \"table\"", [("ALTER", "users"), ("DROP", "old_t")])
golden("x16_liquibase", lambda f: x.liquibase_columns(f).drop("repo_url", "path"), "\"table\", \"column\", type", [("acc", "id", "int"), ("acc", "n", "varchar(9)")])
golden("x20_gorm", lambda f: x.gorm_tables(f).drop("repo_url", "path"), "struct, \"table\"", [("UserProfile", "user_profiles")])
golden("x19_orm_tables", lambda f: x.orm_tables(f).drop("repo_url", "path"), "orm, \"table\"", [("sqlalchemy", "invoices"), ("django", "customer")])
golden("x10_python_symbols", lambda f: x.python_symbols(f.where("path = 'svc/store.py'")).drop("repo_url", "path"), "name, kind, \"class\", line_start, line_end", [
    ("Store", "Class", None, 6, 13), ("load", "Method", "Store", 7, 9), ("save", "Method", "Store", 10, 13), ("create", "Function", None, 15, 16)])
golden("x29_leaves", lambda f: x.leaves(f.where("path = 'conf/app.yml'")).select("key", "value"), "key, value", [("server.port", "8080"), ("server.list[0]", "a"), ("server.list[1]", "b"), ("db.password", "${DB_PASS:none}"), ("variables.CI_TOKEN", "t")])
golden("x27_config_keys", lambda f: x.config_keys(f.where("path = 'conf/app.yml'")).select("key", "kind", "is_secret"), "key, kind, is_secret", [
    ("server.port", "app", False), ("server.list[0]", "app", False), ("server.list[1]", "app", False), ("db.password", "app", True), ("variables.CI_TOKEN", "app", True), ("DB_PASS", "env", False)])
golden("x26_ci_variables", lambda f: x.ci_variables(f.where("path = 'conf/app.yml'")).select("key", "is_secret"), "key, is_secret", [("CI_TOKEN", True)])
golden("x21_openapi", lambda f: x.openapi_operations(f).select("method", "route", "operation_id"), "method, route, operation_id", [("GET", "/users/{id}", "getUser"), ("DELETE", "/users/{id}", None)])
golden("s04_rpc_routes", lambda f: x.rpc_routes(f).select("method", "route"), "method, route", [("RPC", "/Billing/Charge"), ("RPC", "/Billing/Refund"), ("QUERY", "/graphql/user"), ("QUERY", "/graphql/all")])
golden("g24_service_boundaries", lambda f: x.service_boundaries(f).drop("repo_url"), "directory, detection_method", [("svc", "package_json"), ("web", "package_json")])
golden("s01_skip_reasons", lambda f: f.unionByName(f.limit(1).select(F.lit("r").alias("repo_url"), F.lit("node_modules/a.js").alias("path"), "content")).withColumn("reason", src.skip_reason(F.col("path"), F.length("content"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).where("reason is not null"), "reason, n", [("directory", 1), ("extension", 3)])

_LOG = "@@commit@@a1\x1fAnn\x1fann@x.io\x1f2024-01-02\x1ffirst\nsrc/a.ts\nb.md\n@@commit@@b2\x1fBob\x1fbob@x.io\x1f2024-02-03\x1fsecond\nsrc/a.ts\n"


def _log(spark):
    return src.git_log(spark.createDataFrame([("r", _LOG)], "repo_url string, raw string"))


QUERIES["s07_git_log"] = lambda spark, sf_dir: _log(spark)[0].select("sha", "author", "authored_at", "message")
ORACLE_SQL["s07_git_log"] = "SELECT * FROM (VALUES ('a1', 'Ann', '2024-01-02', 'first'), ('b2', 'Bob', '2024-02-03', 'second')) t(sha, author, authored_at, message)"
QUERIES["s06_last_changed"] = lambda spark, sf_dir: src.last_changed(*_log(spark)).drop("repo_url")
ORACLE_SQL["s06_last_changed"] = "SELECT * FROM (VALUES ('src/a.ts', '2024-02-03'), ('b.md', '2024-01-02')) t(path, last_changed)"
QUERIES["x31_history_edges"] = lambda spark, sf_dir: src.history_edges(_log(spark)[1], _files(spark).select("repo_url", F.lit("src/a.ts").alias("path")).distinct())
ORACLE_SQL["x31_history_edges"] = "SELECT * FROM (VALUES ('r#a1', 'r:src/a.ts', 'TOUCHED'), ('r#a1', NULL, 'TOUCHED'), ('r#b2', 'r:src/a.ts', 'TOUCHED')) t(src, dst, type)"
QUERIES["s08_changed_files"] = lambda spark, sf_dir: src.changed_files(
    table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("path"), F.col("p_name").alias("hash")),
    table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("path"), F.when(F.col("p_size") > 40, "new").otherwise(F.col("p_name")).alias("hash")),
)
ORACLE_SQL["s08_changed_files"] = """SELECT p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'added' WHEN p_partkey % 7 = 0 THEN 'deleted' ELSE 'changed' END AS change FROM part
  WHERE (p_partkey % 5 = 0 AND p_partkey % 7 <> 0) OR (p_partkey % 5 <> 0 AND p_partkey % 7 = 0) OR (p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_size > 40)"""
QUERIES["s09_discover"] = lambda spark, sf_dir: src.discover(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_custkey") % 900).alias("size_mb"), (F.col("o_custkey") % 3 == 0).alias("archived")))
ORACLE_SQL["s09_discover"] = "SELECT DISTINCT o_custkey AS id, o_custkey % 900 AS size_mb, o_custkey % 3 = 0 AS archived FROM orders WHERE o_custkey % 900 <= 500 AND o_custkey % 3 <> 0"

QUERIES["z01_push_status"] = lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").select(
    "event_id",
    ev.push_status(
        F.when(F.col("event_type") == "error", "{oops").otherwise(F.to_json(F.struct(F.when(F.col("event_type") == "view", "refs/tags/x").otherwise("refs/heads/main").alias("ref"), F.lit("a").alias("before"), F.lit("b").alias("after"), (F.col("user_id") % 4).cast("int").alias("total_commits_count"), F.struct(F.concat(F.when(F.col("user_id") % 2 == 0, "team/").otherwise("other/"), "user_id").alias("path_with_namespace")).alias("project")))),
        F.when(F.col("user_id") % 11 == 0, "bad").otherwise("s3"), "s3", ["team/*"],
    ).alias("status"),
)
ORACLE_SQL["z01_push_status"] = "SELECT event_id, CASE WHEN user_id % 11 = 0 THEN 401 WHEN event_type = 'error' THEN 400 WHEN user_id % 2 <> 0 THEN 403 WHEN event_type = 'view' OR user_id % 4 = 0 THEN 200 ELSE 202 END AS status FROM events"
QUERIES["z03_ingest_mode"] = lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", ev.ingest_mode(F.col("user_id") % 5, F.when(F.col("user_id") % 7 != 0, F.col("event_id") % 5), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 300)).alias("mode"))
ORACLE_SQL["z03_ingest_mode"] = "SELECT event_id, CASE WHEN user_id % 7 <> 0 AND user_id % 5 = event_id % 5 THEN 'skip' WHEN user_id % 7 = 0 OR event_id % 3 = 0 OR event_id % 300 > 100 THEN 'full' ELSE 'incremental' END AS mode FROM events"
QUERIES["z05_dead_letters"] = lambda spark, sf_dir: ev.with_dead_letters(table(spark, sf_dir, "events"), lambda d: d, F.col("event_type") != "error")[1].select("event_id")
ORACLE_SQL["z05_dead_letters"] = "SELECT event_id FROM events WHERE event_type = 'error'"


def _stream(spark, sf_dir, name, build, mode="append"):
    """The events file as a stream."""
    return ev.replay(spark, sf_dir, table(spark, sf_dir, "events").schema, build, name, mode=mode, only="events.parquet")


QUERIES["z02_stream_dedupe"] = lambda spark, sf_dir: _stream(spark, sf_dir, "z02", lambda s: ev.deduplicated(s, "event_id", "ts").select("event_id"))
ORACLE_SQL["z02_stream_dedupe"] = "SELECT DISTINCT event_id FROM events"
QUERIES["z09_stream_windows"] = lambda spark, sf_dir: _stream(spark, sf_dir, "z09", lambda s: ev.windowed_counts(s, "event_type", "ts", "6 hours"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))
ORACLE_SQL["z09_stream_windows"] = "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"

HELM = "db:\n  url: vault:db/url\n  user: app\nkey: ${secrets.API}\n"
K8S = """kind: ConfigMap
metadata: {name: conf}
data: {A: "1", B: "2"}
---
kind: CronJob
metadata: {name: job}
spec: {jobTemplate: {spec: {template: {spec: {containers: [{name: c, env: [{name: X, value: v}, {name: Y, valueFrom: {secretKeyRef: {name: s, key: k}}}], envFrom: [{secretRef: {name: all}}]}]}}}}}
"""


def _with(spark, path, content):
    return spark.createDataFrame([("r", path, content)], "repo_url string, path string, content string")


golden("x23_helm_values", lambda f: x.helm_values(_with(f.sparkSession, "chart/values.yaml", HELM)).select("key", "label", "vendor"), "key, label, vendor", [("db.url", "SecretRef", "VAULT"), ("db.user", "ConfigKey", None), ("key", "SecretRef", "UNKNOWN")])
golden("x24_k8s_config", lambda f: x.k8s_config(_with(f.sparkSession, "k8s/all.yaml", K8S)).select("source", "name", "key", "is_secret"), "source, name, key, is_secret", [
    ("ConfigMap", "conf", "A", False), ("ConfigMap", "conf", "B", False), ("env", "job", "X", False), ("env", "job", "Y", True), ("envFrom", "job", "all", True)])
golden("x12_symbol_nodes", lambda f: x.symbol_nodes(x.python_symbols(f.where("path = 'svc/store.py'"))).select("id", "label"), "id, label", [
    ("r:cls:svc/store.py:Store@6", "Class"), ("r:method:svc/store.py:load@7", "Method"), ("r:method:svc/store.py:save@10", "Method"), ("r:fn:svc/store.py:create@15", "Function")])
golden("x14_topic_graph", x.topic_graph, "id, producers, consumers", [("topic:orders.created", 1, 0), ("topic:orders.paid", 0, 1)])
golden("x32_extraction", lambda f: x.extraction(f)[0].groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label, n", [("File", 16), ("Database", 1), ("Config", 3), ("Module", 8), ("Topic", 2), ("Class", 2), ("Method", 2), ("Function", 1)])
golden("r09_run_eval", lambda f: _run(f.sparkSession), "id, predicted, class_correct, \"precision\", recall", [("1", "ownership", True, 1, 1), ("2", "unknown", False, 0, 1)])


def _run(spark):
    from graphloom.sources.cases import run_cases

    cases = spark.createDataFrame([("1", "who owns pay-service", "ownership", ["a"]), ("2", "hi", "code", [])], "id string, question string, expectedClass string, goldCitations array<string>")
    return run_cases(cases, spark.createDataFrame([("1", ["a"]), ("2", ["z"])], "id string, citations array<string>"))

#: By language: path, content and facts (kind, value, extra); % stands for the supplier's key.
LANGUAGE_FILES = (
    ("a%.kt", "package p\nimport io.ktor.server.App%\nimport java.util.*\nimport a.b as c\nval k = System.getenv(\"K_%\")\n@GetMapping(\"/kt/%\")\n",
     [("import", "io.ktor.server.App%", ""), ("import", "java.util", ""), ("import", "a.b", ""), ("env", "K_%", ""), ("route", "/kt/%", "Get")]),
    ("b%.scala", "import akka.http.Server%\nimport cats.{A, B}\n  val s = sys.env(\"S_%\")\n sys.env.getOrElse(\"T\", 1)\n",
     [("import", "akka.http.Server%", ""), ("import", "cats", ""), ("env", "S_%", ""), ("env", "T", "")]),
    ("c%.rs", "use std::io::{Read};\npub use crate::m%;\nextern crate serde%;\n#[post(\"/rs/%\")]\nfn f() { Router::new().route(\"/ax/%\", get(h)); reqwest::get(\"http://r%/x\"); env!(\"R_%\"); std::env::var(\"Q\"); }\n",
     [("import", "std::io", ""), ("import", "crate::m%", ""), ("import", "serde%", ""), ("route", "/rs/%", "post"), ("route", "/ax/%", "get"), ("http", "http://r%/x", "get"), ("env", "R_%", ""), ("env", "Q", "")]),
    ("d%.rb", "require 'rails%'\nrequire_relative \"../m\"\n  get '/rb/%', to: 'x#y'\nHTTParty.post('http://h%/y')\nNet::HTTP.get(URI('http://n/z'))\nENV['E_%']; ENV.fetch(\"F\", 1)\nproducer.produce('x', topic: 't.%')\n",
     [("import", "rails%", ""), ("import", "../m", ""), ("route", "/rb/%", "get"), ("http", "http://h%/y", "post"), ("http", "http://n/z", "get"), ("env", "E_%", ""), ("env", "F", ""), ("produce", "t.%", "")]),
    ("e%.php", "<?php\nuse App\\Http\\C%;\nrequire_once('lib%.php');\nRoute::put('/php/%', f);\n$client->delete('http://p%/q');\ngetenv('P_%'); $_ENV[\"Z\"];\n",
     [("import", "App\\Http\\C%", ""), ("import", "lib%.php", ""), ("route", "/php/%", "put"), ("http", "http://p%/q", "delete"), ("env", "P_%", ""), ("env", "Z", "")]),
    ("f%.cs", "using System;\nusing My.Ns%;\nusing (var x = y) {}\n[HttpPatch(\"cs/%\")]\napp.MapGet(\"/min/%\", f);\nnew HttpClient().PostAsync(\"http://c%/w\", b);\nEnvironment.GetEnvironmentVariable(\"C_%\");\n",
     [("import", "System", ""), ("import", "My.Ns%", ""), ("route", "cs/%", "Patch"), ("route", "/min/%", "Get"), ("http", "http://c%/w", "Post"), ("env", "C_%", "")]),
    ("g%.h", "#include <stdio.h>\n # include \"m%.h\"\nchar *x = getenv(\"H_%\");\n", [("import", "stdio.h", ""), ("import", "m%.h", ""), ("env", "H_%", "")]),
    ("h%.cxx", "#include <vector>\nauto y = std::getenv(\"X_%\"); // getenv(name)\n", [("import", "vector", ""), ("env", "X_%", "")]),
    ("i%.java", "import static a.B.c;\nimport d.*;\n@Path(\"/jax/%\")\n@Value(\"${V_%:x}\")\n", [("import", "a.B.c", ""), ("import", "d", ""), ("route", "/jax/%", ""), ("env", "V_%", "")]),
    ("j%.pyi", "from a.b import c\nurlpatterns = [\n  path('dj/%/', v),\n]\n", [("import", "a.b", ""), ("route", "dj/%/", "")]),
)


def _of_languages(supplier):
    """A file a supplier, in turn of each language."""
    at = (F.col("s_suppkey") % len(LANGUAGE_FILES) + 1).cast("int")
    pick = lambda i: F.replace(F.element_at(F.array(*(F.lit(f[i]) for f in LANGUAGE_FILES)), at), F.lit("%"), F.col("s_suppkey").cast("string"))
    return supplier.select(F.lit("r").alias("repo_url"), pick(0).alias("path"), pick(1).alias("content"))


def _expected() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [(i, f[0], *fact) for i, f in enumerate(LANGUAGE_FILES) for fact in f[2]]
    return ", ".join(f"({i}, {', '.join(map(quote, r))})" for i, *r in rows)


QUERIES["s03_language_facts"] = lambda spark, sf_dir: x.facts(_of_languages(table(spark, sf_dir, "supplier")), "import", "route", "http", "env", "produce").drop("repo_url")
ORACLE_SQL["s03_language_facts"] = f"""SELECT replace(path, '%', s_suppkey::VARCHAR) AS path, kind, replace(value, '%', s_suppkey::VARCHAR) AS value, extra
  FROM supplier JOIN (VALUES {_expected()}) t(turn, path, kind, value, extra) ON s_suppkey % {len(LANGUAGE_FILES)} = turn"""

#: A TypeScript file; % stands for the supplier's key, which also shifts its lines.
TS_FILE = """import express, { Router as R, type Req } from 'express';
import * as db from "./db%";
// function no() {}
export async function load%(id: string, r: Req): Promise<User[]> {
  if (id && r || x?.y) { for (const a of b) { } }
  const s = `a ${fmt({k: 1})} } function z() {`;
  return db.query(/\\/}{/g, id ? 1 : 2);
}
export const save = async (u: User) => {
  load%(u.id);
  R();
};
const v = (1 + 2) * 3;
interface User { id: string; f(): void }
type Alias = { a: number }
  | User;
export class Store extends Base {
  private cache = new Map();
  constructor(private u: User) { super(); fmt(); this.get('x'); }
  static async get<T>(k: string): Promise<{ a: T }> {
    try { do { k++ } while (k); } catch (e) { switch (k) { case 1: default: } }
    return this.put(k);
  }
  private put(k?: string) { return save(k ?? ''); }
}
class Base {}
function fmt(o) { return new Store(o); }
"""
#: label, prefix of the id, name, class, first and last line, exported, complexity
TS_SYMBOLS = (
    ("Function", "fn", "load%", None, 4, 8, True, 6), ("Function", "fn", "save", None, 9, 12, True, 1), ("Function", "fn", "fmt", None, 27, 27, False, 1),
    ("TypeDef", "type", "User", None, 14, 14, False, None), ("TypeDef", "type", "Alias", None, 15, 16, False, None), ("Class", "cls", "Store", None, 17, 25, True, None),
    ("Class", "cls", "Base", None, 26, 26, False, None), ("Method", "method", "get", "Store", 20, 23, None, 4), ("Method", "method", "put", "Store", 24, 24, None, 1),
)
#: kind, source, target (names of symbols, or what an import names), resolved
TS_EDGES = (
    ("CALLS", "load%", "fmt", True), ("CALLS", "load%", "query@./db%", False), ("CALLS", "save", "load%", True), ("CALLS", "save", "R@express", False),
    ("CALLS", "Store", "fmt", True), ("CALLS", "Store", "get", True), ("CALLS", "get", "put", True), ("CALLS", "put", "save", True), ("EXTENDS", "Store", "Base", True),
    ("USES_TYPE", "load%", "Req@express", False), ("USES_TYPE", "load%", "User", True), ("USES_TYPE", "save", "User", True), ("USES_TYPE", "Store", "User", True),
)


def _typescript(spark, sf_dir):
    """A TypeScript file a supplier, its lines shifted by the nation's key."""
    body = F.concat(F.repeat(F.lit("\n"), F.col("s_nationkey")), F.replace(F.lit(TS_FILE), F.lit("%"), F.col("s_suppkey").cast("string")))
    return ts.typescript_facts(table(spark, sf_dir, "supplier").select(F.lit("r").alias("repo_url"), F.concat(F.col("s_name"), F.lit(".ts")).alias("path"), body.alias("content")))


def _rows(rows) -> str:
    quote = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join(f"({', '.join(map(quote, r))})" for r in rows)


_FILLED = "replace({}, '%', s_suppkey::VARCHAR)"
_SYMBOLS = f"""SELECT s_suppkey, s_name || '.ts' AS path, kind, {_FILLED.format('sym')} AS name, sym, class, first + s_nationkey AS line_start, last + s_nationkey AS line_end, exported, complexity,
  'r:' || prefix || ':' || s_name || '.ts:' || {_FILLED.format('sym')} || '@' || (first + s_nationkey) AS id FROM supplier, (VALUES {_rows(TS_SYMBOLS)}) t(kind, prefix, sym, class, first, last, exported, complexity)"""
QUERIES["x09_typescript_symbols"] = lambda spark, sf_dir: _typescript(spark, sf_dir).where("id is not null").select("path", "kind", "id", "name", "owner", "line_start", "line_end", "is_exported", "complexity")
ORACLE_SQL["x09_typescript_symbols"] = f"""SELECT a.path, a.kind, a.id, a.name, b.id AS owner, a.line_start, a.line_end, a.exported AS is_exported, a.complexity
  FROM ({_SYMBOLS}) a LEFT JOIN ({_SYMBOLS}) b ON a.s_suppkey = b.s_suppkey AND a.class = b.sym"""
QUERIES["x09b_typescript_edges"] = lambda spark, sf_dir: _typescript(spark, sf_dir).where("id is null").select("path", "kind", "owner", "target", "resolved")
ORACLE_SQL["x09b_typescript_edges"] = f"""SELECT a.path, e.kind, a.id AS owner, coalesce(b.id, replace(e.target, '%', a.s_suppkey::VARCHAR)) AS target, resolved
  FROM (VALUES {_rows(TS_EDGES)}) e(kind, source, target, resolved) JOIN ({_SYMBOLS}) a ON a.sym = e.source LEFT JOIN ({_SYMBOLS}) b ON b.sym = e.target AND b.s_suppkey = a.s_suppkey"""

#: By ending: a document (% stands for the supplier's key) and its headings (level, text, line).
DOCUMENTS = (
    ("rst", "=====\nBig %\n==============================\n\n Part \r\n~~~~~~~~~~~~\ntext\n--\n====\n====\n====\nToo long a title\n---\nMixed\n=-=-=-=\n", ((1, "Big %", 2), (2, "Part", 5), (2, "--", 8), (2, "====", 10))),
    ("adoc", "= Top %\ntext = no\n=== Deep  \n==\n==None\n", ((1, "Top %", 1), (3, "Deep", 3))),
    ("md", "# One %\n```\n# no\n```\nTwo\n---\n", ((1, "One %", 1), (2, "Two", 5))),
    ("txt", "# None\n", ()),
)


def _of_documents(supplier):
    """A document a supplier, in turn of each format."""
    at = (F.col("s_suppkey") % len(DOCUMENTS) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(d[i]) for d in DOCUMENTS)), at)
    text = F.replace(pick(1), F.lit("%"), F.col("s_suppkey").cast("string"))
    return supplier.select(F.lit("r").alias("repo_url"), F.concat("s_name", F.lit("."), pick(0)).alias("path"), text.alias("content"))


QUERIES["x22c_document_headings"] = lambda spark, sf_dir: x.document_headings(_of_documents(table(spark, sf_dir, "supplier"))).drop("repo_url")
ORACLE_SQL["x22c_document_headings"] = f"""SELECT s_name || '.' || ending AS path, level, {_FILLED.format('text')} AS text, line
  FROM supplier JOIN (VALUES {_rows((i, d[0], *h) for i, d in enumerate(DOCUMENTS) for h in d[2])}) t(turn, ending, level, text, line) ON s_suppkey % {len(DOCUMENTS)} = turn"""
