"""Databases named in configuration: dotenv files, JSON below configuration folders, compose files.

Each function takes files(repo_url, path, content). Only files at a repository's root, or directly
below one of its configuration folders, count; null contents give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Files and folders that are read, and what tells a database, first match first.
ENV_FILES = (".env", ".env.example", ".env.development", ".env.production", ".env.local")
CONFIG_DIRS = ("config", "configs", "conf", "settings")
COMPOSE_FILES = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
URL_SCHEMES = (
    (r"mongodb(?:\+srv)?://", "MongoDB"), (r"postgres(?:ql)?://", "PostgreSQL"), ("mysql://", "MySQL"), ("redis://", "Redis"),
    ("couchbase://", "Couchbase"), ("amqp://", "RabbitMQ"), ("mssql://", "MSSQL"),
)
KEY_PATTERNS = (
    "database.?url", "db.?url", "db.?host", "db.?connection", "mongo.?uri", "redis.?url", "redis.?host", "postgres.?url", "mysql.?host",
    "couchbase.?url", "couchbase.?host", "connection.?string",
)
KEY_WORDS = (("mongo", "MongoDB"), ("redis", "Redis"), ("postgres|pg", "PostgreSQL"), ("mysql", "MySQL"), ("couchbase|cb", "Couchbase"))
IMAGES = (
    ("mongo", "MongoDB"), ("postgres", "PostgreSQL"), ("mysql", "MySQL"), ("redis", "Redis"), ("couchbase", "Couchbase"), ("neo4j", "Neo4j"),
    ("rabbitmq", "RabbitMQ"), ("elasticsearch", "Elasticsearch"),
)


def _first(c: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first pattern of a table that stands in `c`, case ignored; null if none does."""
    return reduce(lambda when, row: when.when(c.rlike(f"(?i){row[0]}"), row[1]), table, F.when(F.lit(False), ""))


def config_variables(files: DataFrame) -> DataFrame:
    """Variables of dotenv files: key, value (one quote off each end), database (by URL, else by key), is_database_related."""
    rows = files.where(F.col("path").isin(*ENV_FILES)).select("repo_url", "path", F.explode(F.split("content", "\n")).alias("line"))
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = rows.select("repo_url", "path", line.alias("line")).where("line <> '' and line not like '#%' and line like '%=%'")
    value = F.regexp_replace(F.regexp_extract("line", r"(?s)=\s*(.*)$", 1), "^[\"']|[\"']$", "")
    rows = rows.select("repo_url", "path", F.regexp_extract("line", r"^([^=]*?)\s*=", 1).alias("key"), value.alias("value"))
    named, by_url = F.col("key").rlike("(?i)" + "|".join(KEY_PATTERNS)), _first(F.col("value"), URL_SCHEMES)
    return rows.select("*", F.coalesce(by_url, F.when(named, _first(F.col("key"), KEY_WORDS))).alias("database"), (named | by_url.isNotNull()).alias("is_database_related"))


def config_databases(files: DataFrame) -> DataFrame:
    """Databases of each configuration file, each once: repo_url, path, database, detected_via, package_name (the file's name).

    A JSON file that does not parse names none; of others all string values count, at any depth,
    keys do not. Escaped slashes are read as slashes, other escapes are left out of the match.
    """
    env = config_variables(files).where("database is not null").select("repo_url", "path", "database")

    folder, own = F.regexp_extract("path", "^([^/]+)/[^/]+$", 1), F.col("content")
    plain = F.regexp_replace(own, r"\\([^/])|\\(/)", "$2")
    tokens = F.arrays_zip(F.regexp_extract_all(plain, F.lit(r'"([^"]*)"(\s*:)?'), F.lit(1)).alias("s"), F.regexp_extract_all(plain, F.lit(r'"([^"]*)"(\s*:)?'), F.lit(2)).alias("colon"))
    documents = files.where(folder.isin(*CONFIG_DIRS) & F.lower("path").endswith(".json") & F.try_parse_json(own).isNotNull())
    strings = documents.select("repo_url", "path", F.explode(tokens).alias("t")).where("t.colon = ''")
    in_json = strings.select("repo_url", "path", _first(F.col("t.s"), URL_SCHEMES).alias("database"))

    images = F.array(*(F.when(own.rlike(f"(?i)image:\\s*['\"]?{image}"), name) for image, name in IMAGES))
    composed = files.where(F.col("path").isin(*COMPOSE_FILES)).select("repo_url", "path", F.explode(images).alias("database"))

    rows = env.unionByName(in_json).unionByName(composed).where("database is not null").distinct()
    return rows.select("*", F.lit("config_file").alias("detected_via"), F.regexp_extract("path", "([^/]+)$", 1).alias("package_name"))
