"""Facts from source, schema, config and documentation files.

Each function takes files(repo_url, path, content) and returns one row per fact. Patterns are
rows of a small table joined by language, so a new language is data, not code; what needs a
parser (YAML, JSON trees) runs in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import secret_key, snake_plural
from graphloom.operators.typescript import typescript_facts
from graphloom.sources.files import language

#: (kind, language, pattern, group of the first value, group of the second value; 0: none, -n: the constant below)
PATTERNS = (
    ("import", "typescript", r"(?m)^\s*(?:import|export)\b[^'\";]*?from\s*['\"]([^'\"]+)['\"]", 1, 0),
    ("import", "typescript", r"(?m)^\s*import\s*['\"]([^'\"]+)['\"]", 1, 0),
    ("import", "typescript", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", 1, 0),
    ("import", "python", r"(?m)^\s*from\s+([\w.]+)\s+import\b", 1, 0),
    ("import", "python", r"(?m)^\s*import\s+([\w.]+)", 1, 0),
    ("import", "go", r"(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$", 1, 0),
    ("import", "java", r"(?m)^\s*import\s+(?:static\s+)?(\w+(?:\.\w+)*)(?:\.\*)?(?:\s+as\s+\w+)?[ \t]*;?[ \t]*\r?$", 1, 0),
    ("import", "scala", r"(?m)^\s*import\s+(\w+(?:\.\w+)*)", 1, 0),
    ("import", "rust", r"(?m)^\s*(?:pub\s+)?use\s+(\w+(?:::\w+)*)", 1, 0),
    ("import", "rust", r"(?m)^\s*extern\s+crate\s+(\w+)", 1, 0),
    ("import", "php", r"(?m)^\s*use\s+\\?(\w+(?:\\\w+)*)(?:\s+as\s+\w+)?\s*;", 1, 0),
    ("import", "php", r"(?m)^\s*(?:require|include)(?:_once)?\b[\s(]*['\"]([^'\"]+)['\"]", 1, 0),
    ("import", "csharp", r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(\w+(?:\.\w+)*)\s*;", 1, 0),
    ("import", "c", r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", 1, 0),
    ("import", "ruby", r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", 1, 0),
    ("route", "typescript", r"\b(?:app|router)\.(get|post|put|patch|delete)\(\s*['\"`]([^'\"`]+)['\"`]", 2, 1),
    ("route", "typescript", r"@(Get|Post|Put|Patch|Delete)\(\s*['\"`]([^'\"`]*)['\"`]\s*\)", 2, 1),
    ("route", "python", r"@\w+\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]", 2, 1),
    ("route", "python", r"@\w+\.route\(\s*['\"]([^'\"]+)['\"](?:[^)]*methods\s*=\s*\[\s*['\"](\w+)['\"])?", 1, 2),
    ("route", "go", r"\.(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\(\s*\"(/[^\"]*)\"", 2, 1),
    ("route", "go", r"\bHandleFunc\(\s*\"(?:(GET|POST|PUT|PATCH|DELETE) )?(/[^\"]*)\"", 2, 1),
    ("route", "java", r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]*)\"", 2, 1),
    ("route", "java", r"@RequestMapping\(\s*(?:value\s*=\s*)?\"([^\"]*)\"(?:\s*,\s*method\s*=\s*RequestMethod\.(\w+))?", 1, 2),
    ("route", "java", r"@Path\(\s*\"([^\"]+)\"", 1, 0),
    ("route", "python", r"(?m)^\s*(?:re_)?path\(\s*r?['\"]([^'\"]+)['\"]", 1, 0),
    ("route", "rust", r"#\[(get|post|put|patch|delete)\(\s*\"([^\"]+)\"", 2, 1),
    ("route", "rust", r"\.route\(\s*\"([^\"]+)\"\s*,\s*(?:web::)?(get|post|put|patch|delete)\b", 1, 2),
    ("route", "ruby", r"(?m)^\s*(get|post|put|patch|delete)[\s(]+['\"]([^'\"]+)['\"]", 2, 1),
    ("route", "php", r"\bRoute::(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]", 2, 1),
    ("route", "csharp", r"\[Http(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]+)\"", 2, 1),
    ("route", "csharp", r"\.Map(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]+)\"", 2, 1),
    ("http", "typescript", r"\b(?:axios|http|client)\.(get|post|put|patch|delete)\(\s*['\"`]([^'\"`]+)['\"`]", 2, 1),
    ("http", "typescript", r"\b(fetch)\(\s*['\"`]([^'\"`]+)['\"`]", 2, 1),
    ("http", "python", r"\b(?:requests|httpx|client)\.(get|post|put|patch|delete)\(\s*f?['\"]([^'\"]+)['\"]", 2, 1),
    ("http", "go", r"\bhttp\.(Get|Post|Head)\(\s*\"([^\"]+)\"", 2, 1),
    ("http", "java", r"\.(getForObject|postForObject|getForEntity|postForEntity|exchange)\(\s*\"([^\"]+)\"", 2, 1),
    ("http", "rust", r"\breqwest::(?:blocking::)?(get)\(\s*\"([^\"]+)\"", 2, 1),
    ("http", "rust", r"\bClient::new\(\)\s*\.(get|post|put|patch|delete|head)\(\s*\"([^\"]+)\"", 2, 1),
    ("http", "ruby", r"\b(?:HTTParty|Faraday|RestClient)\.(get|post|put|patch|delete|head)[\s(]+['\"]([^'\"]+)['\"]", 2, 1),
    ("http", "ruby", r"\bNet::HTTP\.(get|post)\w*\(\s*URI(?:\.parse)?\(\s*['\"]([^'\"]+)['\"]", 2, 1),
    ("http", "php", r"\$\w*(?:client|http)\w*->(get|post|put|patch|delete|head)\(\s*['\"]([^'\"]+)['\"]", 2, 1),
    ("http", "csharp", r"\.(Get|Post|Put|Patch|Delete)(?:String|FromJson|AsJson)?Async\(\s*\"([^\"]+)\"", 2, 1),
    ("env", "typescript", r"process\.env(?:\.|\[['\"])([A-Z_][A-Z0-9_]*)", 1, 0),
    ("env", "python", r"os\.(?:environ\.get\(|getenv\(|environ\[)\s*['\"]([A-Z_][A-Z0-9_]*)", 1, 0),
    ("env", "go", r"os\.(?:Getenv|LookupEnv)\(\s*\"([A-Z_][A-Z0-9_]*)", 1, 0),
    ("env", "java", r"System\.getenv\(\s*\"([A-Z_][A-Z0-9_]*)", 1, 0),
    ("env", "java", r"@Value\(\s*\"\$\{([A-Z_][A-Z0-9_]*)", 1, 0),
    ("env", "scala", r"\bsys\.env(?:\.get|\.getOrElse)?\(\s*\"([A-Z_][A-Z0-9_]*)", 1, 0),
    ("env", "rust", r"\benv(?:::var(?:_os)?|!)\(\s*\"([A-Z_][A-Z0-9_]*)", 1, 0),
    ("env", "ruby", r"\bENV(?:\.fetch\(|\[)\s*['\"]([A-Z_][A-Z0-9_]*)", 1, 0),
    ("env", "php", r"(?:\bgetenv\(|\$_ENV\[)\s*['\"]([A-Z_][A-Z0-9_]*)", 1, 0),
    ("env", "csharp", r"\bGetEnvironmentVariable\(\s*\"([A-Z_][A-Z0-9_]*)", 1, 0),
    ("env", "c", r"\bgetenv\(\s*\"([A-Z_][A-Z0-9_]*)", 1, 0),
    ("produce", "typescript", r"\.send\(\s*\{\s*topic:\s*['\"`]([^'\"`]+)['\"`]", 1, 0),
    ("consume", "typescript", r"\.subscribe\(\s*\{\s*topics?:\s*\[?\s*['\"`]([^'\"`]+)['\"`]", 1, 0),
    ("produce", "python", r"\.(?:send|produce)\(\s*['\"]([^'\"]+)['\"]", 1, 0),
    ("consume", "python", r"\bKafkaConsumer\(\s*['\"]([^'\"]+)['\"]|\.subscribe\(\s*\[\s*['\"]([^'\"]+)['\"]", 1, 2),
    ("consume", "java", r"@KafkaListener\([^)]*topics\s*=\s*\{?\s*\"([^\"]+)\"", 1, 0),
    ("produce", "ruby", r"\.produce\([^,\n]+,\s*topic:\s*['\"]([^'\"]+)['\"]", 1, 0),
    ("produce", "java", r"kafkaTemplate\.send\(\s*\"([^\"]+)\"", 1, 0),
)
# Database of each client package, exact names first.
DATABASES = {
    "couchbase": "Couchbase", "mongoose": "MongoDB", "mongodb": "MongoDB", "pg": "PostgreSQL", "mysql2": "MySQL", "mysql": "MySQL", "redis": "Redis",
    "ioredis": "Redis", "better-sqlite3": "SQLite", "sqlite3": "SQLite", "typeorm": "TypeORM", "sequelize": "Sequelize", "prisma": "Prisma",
    "@prisma/client": "Prisma", "knex": "Knex", "drizzle-orm": "Drizzle", "cassandra-driver": "Cassandra", "@elastic/elasticsearch": "Elasticsearch",
    "neo4j-driver": "Neo4j", "mssql": "MSSQL", "psycopg2": "PostgreSQL", "psycopg": "PostgreSQL", "asyncpg": "PostgreSQL", "pymongo": "MongoDB",
    "motor": "MongoDB", "redis-py": "Redis", "aioredis": "Redis", "sqlalchemy": "SQLAlchemy", "pymysql": "MySQL", "cassandra-driver-py": "Cassandra",
    "elasticsearch": "Elasticsearch", "cx_Oracle": "Oracle", "org.springframework.data.mongodb": "MongoDB", "org.springframework.data.redis": "Redis",
    "org.postgresql": "PostgreSQL", "com.mysql": "MySQL", "org.hibernate": "Hibernate", "redis.clients.jedis": "Redis", "com.couchbase.client": "Couchbase",
    "org.elasticsearch.client": "Elasticsearch", "oracle.jdbc": "Oracle", "github.com/lib/pq": "PostgreSQL", "github.com/jackc/pgx": "PostgreSQL",
    "github.com/go-sql-driver/mysql": "MySQL", "go.mongodb.org/mongo-driver": "MongoDB", "github.com/redis/go-redis": "Redis",
    "github.com/go-redis/redis": "Redis", "github.com/couchbase/gocb": "Couchbase", "github.com/elastic/go-elasticsearch": "Elasticsearch",
    "gorm.io/gorm": "GORM", "sqlx": "SQLx", "diesel": "Diesel", "mongodb-rs": "MongoDB", "redis-rs": "Redis",
}


def facts(files: DataFrame, *kinds: str) -> DataFrame:
    """Pattern facts of the wanted kinds: repo_url, path, kind, value, extra (a method where there is one), distinct."""
    own = language(F.col("path"))
    lang = F.when(own == "javascript", "typescript").when(own == "kotlin", "java").when(own == "cpp", "c").otherwise(own)
    rows = files.select("repo_url", "path", "content", lang.alias("lang"))
    arrays = []
    for kind, own, pattern, a, b in PATTERNS:
        if kind in kinds:
            pick = lambda g, pattern=pattern: F.regexp_extract_all("content", F.lit(pattern), F.lit(g))
            pairs = F.arrays_zip(pick(a).alias("value"), (pick(b) if b else F.transform(pick(a), lambda _: F.lit(""))).alias("extra"))
            made = F.transform(pairs, _tagged(kind))
            arrays.append(F.when((F.col("lang") == own) & F.col("content").rlike(pattern), made).otherwise(F.expr("cast(array() as array<struct<kind:string,value:string,extra:string>>)")))
    return rows.select("repo_url", "path", F.explode(F.concat(*arrays)).alias("f")).select("repo_url", "path", "f.*").distinct()


def _tagged(kind: str):
    return lambda p: F.struct(F.lit(kind).alias("kind"), p["value"].alias("value"), p["extra"].alias("extra"))


def imports(files: DataFrame) -> DataFrame:
    """Imports with their locality: a leading dot or slash, or a crate/self path, is local."""
    rows = facts(files, "import")
    return rows.select("repo_url", "path", F.col("value").alias("source"), F.col("value").rlike(r"^(?:\.|/|crate\b|self\b|super\b)").alias("is_local"))


def routes(files: DataFrame) -> DataFrame:
    method = F.upper(F.when(F.col("extra") == "", "GET").otherwise(F.col("extra")))
    return facts(files, "route").select("repo_url", "path", method.alias("method"), F.when(F.col("value").startswith("/"), F.col("value")).otherwise(F.concat(F.lit("/"), "value")).alias("route"))


def http_calls(files: DataFrame) -> DataFrame:
    """Calls whose URL starts with http or a slash (or a template hole)."""
    verb = F.upper(F.regexp_extract("extra", r"(?i)^(get|post|put|patch|delete|head)", 1))
    rows = facts(files, "http").where(F.col("value").rlike(r"^(?:http|/|\$\{)"))
    return rows.select("repo_url", "path", F.when(verb == "", "GET").otherwise(verb).alias("method"), F.col("value").alias("url"), F.col("value").contains("${").alias("is_template"))


def env_vars(files: DataFrame) -> DataFrame:
    return facts(files, "env").select("repo_url", "path", F.col("value").alias("name")).distinct()


def topics(files: DataFrame) -> DataFrame:
    """Topics and whether they are produced or consumed; lists are split at commas."""
    rows = facts(files, "produce", "consume")
    value = F.when(F.col("value") == "", F.col("extra")).otherwise(F.col("value"))
    return rows.select("repo_url", "path", "kind", F.explode(F.split(value, r"\s*,\s*")).alias("topic")).distinct()


def database_uses(files: DataFrame) -> DataFrame:
    """Databases by imported package: the exact name, else the first prefix in table order."""
    spark = files.sparkSession
    table = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(DATABASES.items())], "seq int, package string, database string")
    rows = imports(files).where("not is_local").select("repo_url", "path", "source")
    hit = rows.join(F.broadcast(table), (F.col("source") == F.col("package")) | F.col("source").startswith(F.concat("package", F.lit("/"))) | F.col("source").startswith(F.concat("package", F.lit("."))))  # a fixed table
    best = F.min_by("database", F.when(F.col("source") == F.col("package"), -1).otherwise(F.col("seq")))
    return hit.groupBy("repo_url", "path", "source").agg(best.alias("database"))


def import_edges(files: DataFrame) -> DataFrame:
    """IMPORTS edges from files to modules, USES edges to databases, READS_CONFIG edges to variables."""
    file_id = F.concat_ws(":", "repo_url", "path")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    module = F.when(F.col("is_local"), F.concat(F.col("repo_url"), F.lit(":"), folder, F.lit("/"), F.col("source"))).otherwise(F.concat(F.lit("npm:"), "source"))
    a = imports(files).select(file_id.alias("src"), module.alias("dst"), F.lit("IMPORTS").alias("type"))
    b = database_uses(files).select(file_id.alias("src"), F.concat(F.lit("db:"), F.lower("database")).alias("dst"), F.lit("USES").alias("type"))
    c = env_vars(files).select(file_id.alias("src"), F.concat(F.lit("config:env:"), "name").alias("dst"), F.lit("READS_CONFIG").alias("type"))
    d = topics(files).select(file_id.alias("src"), F.concat(F.lit("topic:"), "topic").alias("dst"), F.when(F.col("kind") == "produce", "PRODUCES").otherwise("CONSUMES").alias("type"))
    return a.unionByName(b).unionByName(c).unionByName(d).distinct()


def lines(files: DataFrame) -> DataFrame:
    """Lines of each row of files; `file` tells the rows apart, as paths may occur more than once."""
    return files.withColumn("file", F.monotonically_increasing_id()).select("repo_url", "path", "file", F.posexplode(F.split("content", "\r?\n", -1)).alias("n", "line"))


def headings(files: DataFrame) -> DataFrame:
    """Headings of Markdown files outside code fences, ATX and Setext: level, text, line."""
    w = Window.partitionBy("file").orderBy("n")
    rows = lines(files).withColumns({"fences": F.sum(F.col("line").rlike("^\\s*(?:```|~~~)").cast("int")).over(w), "next": F.lead("line").over(w)}).where("fences % 2 = 0")
    level = F.when(F.col("line").rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract("line", "^(#+)", 1))).when((F.trim("line") != "") & ~F.col("line").rlike(r"^[-=#>*\s]") & F.col("next").rlike("^=+\\s*$"), 1).when((F.trim("line") != "") & ~F.col("line").rlike(r"^[-=#>*\s]") & F.col("next").rlike("^-{2,}\\s*$"), 2)
    text = F.trim(F.regexp_replace(F.regexp_replace("line", r"^#{1,6}\s+", ""), r"\s+#+\s*$", ""))
    return rows.select("repo_url", "path", level.alias("level"), text.alias("text"), (F.col("n") + 1).alias("line")).where("level is not null")


def rst_headings(files: DataFrame) -> DataFrame:
    """Headings of reStructuredText files: a text over a line of one repeated mark, at least as long; the first has level 1, others 2.

    A line that underlines one heading is no heading itself: of lines in a row that all qualify, every other one counts.
    """
    w = Window.partitionBy("file").orderBy("n")
    text, under = F.regexp_replace("line", r"^\s+|\s+$", ""), F.regexp_replace("next", r"\s+$", "")
    rows = lines(files).withColumn("next", F.lead("line").over(w)).withColumns({"text": text, "under": under})
    fits = F.coalesce((F.col("text") != "") & F.col("under").rlike(r"^([=\-`:'\"~^_*+#])\1+$") & (F.length("under") >= F.length("text")), F.lit(False))
    rows = rows.withColumn("fits", fits).withColumn("rest", F.sum((~F.col("fits")).cast("int")).over(w)).where("fits")
    in_run = F.row_number().over(Window.partitionBy("file", "rest").orderBy("n"))
    found = rows.withColumn("place", in_run).where("place % 2 = 1")
    return found.select("repo_url", "path", F.when(F.row_number().over(w) == 1, 1).otherwise(2).alias("level"), "text", (F.col("n") + 1).alias("line"))


def adoc_headings(files: DataFrame) -> DataFrame:
    """Headings of AsciiDoc files: as many equals signs as the level, then a text."""
    mark = r"^(=+)\s+(\S.*?)\s*$"
    rows = lines(files).where(F.col("line").rlike(mark))
    return rows.select("repo_url", "path", F.length(F.regexp_extract("line", mark, 1)).alias("level"), F.regexp_extract("line", mark, 2).alias("text"), (F.col("n") + 1).alias("line"))


def document_headings(files: DataFrame) -> DataFrame:
    """Headings of all documents by the format that their ending names: repo_url, path, level, text, line."""
    of = lambda *ends: files.where(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*ends))
    return headings(of("md", "mdx")).unionByName(rst_headings(of("rst"))).unionByName(adoc_headings(of("adoc")))


def doc_stats(files: DataFrame) -> DataFrame:
    """Per document: kind by path and name, code blocks, links."""
    name = F.lower("path")
    kind = F.when(name.rlike("(?:^|/)readme"), "readme").when(name.rlike("(?:^|/)adrs?/|(?:^|/)adr-"), "adr").when(name.contains("runbook"), "runbook").when(name.contains("changelog"), "changelog").when(name.rlike("(?:^|/)docs?/"), "guide").otherwise("other")
    fences = F.size(F.regexp_extract_all("content", F.lit("(?m)^\\s*(?:```|~~~)"), F.lit(0)))
    links = F.size(F.regexp_extract_all("content", F.lit(r"\[[^\]]*\]\([^)\s]+\)"), F.lit(0)))
    return files.select("repo_url", "path", kind.alias("kind"), F.floor(fences / 2).cast("int").alias("code_blocks"), links.alias("links"))


def dotenv(files: DataFrame) -> DataFrame:
    """Keys of dotenv templates with their defaults (quotes and trailing comments off) and whether they look secret; never of a plain .env."""
    rows = lines(files.where(~F.col("path").rlike(r"(?:^|/)\.env$")))
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    hit = rows.where(F.col("line").rlike(pattern)).select("repo_url", "path", (F.col("n") + 1).alias("line"), F.regexp_extract("line", pattern, 1).alias("key"), F.regexp_extract("line", pattern, 2).alias("v"))
    value = F.when(F.col("v").rlike("^([\"']).*\\1"), F.regexp_extract("v", "^([\"'])(.*?)\\1", 2)).otherwise(F.trim(F.regexp_replace("v", r"\s+#.*$", "")))
    return hit.select("repo_url", "path", "line", "key", value.alias("value"), secret_key(F.col("key")).alias("is_secret"))


def codeowners(files: DataFrame) -> DataFrame:
    """Rules in order: seq, pattern, owners; comments stripped, owners are the words with an @."""
    rows = lines(files).withColumn("t", F.split(F.trim(F.regexp_replace("line", r"(?:^|\s)#.*$", "")), r"\s+"))
    owners = F.filter(F.slice("t", 2, 10_000), lambda x: x.contains("@"))
    return rows.select("repo_url", "path", F.col("n").alias("seq"), F.col("t")[0].alias("pattern"), owners.alias("owners")).where((F.col("pattern") != "") & (F.size("owners") > 0))


def owner_nodes(rules: DataFrame) -> DataFrame:
    """Distinct owners: a handle with a slash is a team, one with a domain an e-mail, others users."""
    o = rules.select(F.explode("owners").alias("o")).select(F.lower("o").alias("identifier")).distinct()
    bare = F.regexp_replace("identifier", "^@", "")
    kind = F.when(F.col("identifier").contains("/"), "team").when(F.col("identifier").rlike(r"^[^@]+@.+\..+"), "email").otherwise("user")
    return o.select(F.concat(F.when(kind == "team", "team:").otherwise("owner:"), bare).alias("id"), "identifier", kind.alias("kind"))


def prisma_fields(files: DataFrame) -> DataFrame:
    """Fields of Prisma models: model, field, type, flags; the open model is carried down the lines."""
    w = Window.partitionBy("file").orderBy("n")
    rows = lines(files.where(F.col("path").endswith(".prisma")))
    opened = F.regexp_extract("line", r"^\s*model\s+(\w+)\s*\{", 1)
    block = F.when(opened != "", opened).when(F.col("line").rlike(r"^\s*\}"), "").when(F.col("line").rlike(r"^\s*(?:enum|type|generator|datasource)\b"), "")
    rows = rows.withColumn("model", F.last(block, ignorenulls=True).over(w))
    pattern = r"^\s*(\w+)\s+(\w+)(\[\])?(\?)?(.*)$"
    hit = rows.where((F.col("model") != "") & F.col("line").rlike(pattern) & ~F.col("line").rlike(r"^\s*(?:model|//|@@)"))
    return hit.select(
        "repo_url", "path", F.col("model").alias("table"), F.regexp_extract("line", pattern, 1).alias("column"), F.regexp_extract("line", pattern, 2).alias("type"),
        (F.regexp_extract("line", pattern, 4) == "?").alias("nullable"), F.col("line").rlike(r"@id\b").alias("is_primary"), (F.regexp_extract("line", pattern, 3) == "[]").alias("is_list"),
    )


def ddl_columns(files: DataFrame) -> DataFrame:
    """Columns of CREATE TABLE statements: table, column, type, nullable, primary.

    The statement's body is cut at top-level commas by hiding commas within parentheses.
    """
    create = r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)[\"`\]]?\s*\((.*?)\)\s*;"
    pair = F.arrays_zip(F.regexp_extract_all("content", F.lit(create), F.lit(1)).alias("t"), F.regexp_extract_all("content", F.lit(create), F.lit(2)).alias("body"))
    rows = files.select("repo_url", "path", F.explode(pair).alias("c")).select("repo_url", "path", F.lower("c.t").alias("table"), "c.body")
    cut = F.split(F.regexp_replace("body", r",(?=[^()]*(?:\([^()]*\)[^()]*)*$)", "\u0001"), "\u0001")
    parts = rows.select("repo_url", "path", "table", F.explode(cut).alias("p")).withColumn("p", F.trim(F.regexp_replace("p", r"\s+", " ")))
    column = parts.where(~F.col("p").rlike(r"(?i)^(?:primary|foreign|unique|constraint|check|key|index)\b") & (F.col("p") != ""))
    keys = parts.where(F.col("p").rlike(r"(?i)^(?:constraint \S+ )?primary key"))
    primary = keys.select("repo_url", "path", "table", F.explode(F.split(F.regexp_extract("p", r"\(([^)]*)\)", 1), r"\s*,\s*")).alias("column")).withColumn("column", F.lower(F.regexp_replace("column", r"[\"`\[\]\s]", ""))).withColumn("pk", F.lit(True))
    made = column.select(
        "repo_url", "path", "table", F.lower(F.regexp_extract("p", r"^[\"`\[]?(\w+)", 1)).alias("column"), F.lower(F.regexp_extract("p", r"^\S+ (\w+(?:\([^)]*\))?)", 1)).alias("type"),
        (~F.col("p").rlike(r"(?i)\bnot null\b|\bprimary key\b")).alias("nullable"), F.col("p").rlike(r"(?i)\bprimary key\b").alias("own_key"),
    )
    joined = made.join(primary, ["repo_url", "path", "table", "column"], "left")
    return joined.select("repo_url", "path", "table", "column", "type", (F.col("nullable") & F.col("pk").isNull()).alias("nullable"), (F.col("own_key") | F.coalesce("pk", F.lit(False))).alias("is_primary"))


def ddl_changes(files: DataFrame) -> DataFrame:
    """ALTER and DROP TABLE statements: operation, table."""
    pattern = r"(?i)\b(alter|drop)\s+table\s+(?:if\s+exists\s+)?[\"`\[]?([\w.]+)"
    pair = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("o"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("t"))
    return files.select("repo_url", "path", F.explode(pair).alias("c")).select("repo_url", "path", F.upper("c.o").alias("operation"), F.lower("c.t").alias("table"))


def liquibase_columns(files: DataFrame) -> DataFrame:
    """Columns of createTable changes of Liquibase XML."""
    table = r"(?s)<createTable[^>]*tableName=\"([^\"]+)\"[^>]*>(.*?)</createTable>"
    pair = F.arrays_zip(F.regexp_extract_all("content", F.lit(table), F.lit(1)).alias("t"), F.regexp_extract_all("content", F.lit(table), F.lit(2)).alias("body"))
    rows = files.select("repo_url", "path", F.explode(pair).alias("c")).select("repo_url", "path", F.col("c.t").alias("table"), F.explode(F.regexp_extract_all("c.body", F.lit(r"<column\b[^>]*>"), F.lit(0))).alias("col"))
    return rows.select("repo_url", "path", "table", F.regexp_extract("col", 'name="([^"]+)"', 1).alias("column"), F.regexp_extract("col", 'type="([^"]+)"', 1).alias("type"))


def gorm_tables(files: DataFrame) -> DataFrame:
    """Go structs with gorm tags as tables, named in snake case and plural."""
    pattern = r"(?s)type\s+(\w+)\s+struct\s*\{([^}]*gorm[^}]*)\}"
    pair = F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))
    return files.where(F.col("path").endswith(".go")).select("repo_url", "path", pair.alias("struct")).select("repo_url", "path", "struct", snake_plural(F.col("struct")).alias("table"))


def orm_tables(files: DataFrame) -> DataFrame:
    """Tables of SQLAlchemy, Django, TypeORM, Drizzle and Sequelize models: orm, table."""
    found = []
    for orm, pattern in (
        ("sqlalchemy", r"__tablename__\s*=\s*['\"](\w+)['\"]"), ("django", r"(?m)^class\s+(\w+)\(\s*models\.Model\s*\)"), ("typeorm", r"@Entity\(\s*(?:\{\s*name:\s*)?['\"](\w+)['\"]"),
        ("drizzle", r"\b(?:pg|mysql|sqlite)Table\(\s*['\"](\w+)['\"]"), ("sequelize", r"sequelize\.define\(\s*['\"](\w+)['\"]"),
    ):
        found.append(F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), _named(orm)))
    return files.select("repo_url", "path", F.explode(F.concat(*found)).alias("x")).select("repo_url", "path", "x.orm", F.lower("x.table").alias("table"))


def _named(orm: str):
    return lambda t: F.struct(F.lit(orm).alias("orm"), t.alias("table"))


def python_symbols(files: DataFrame) -> DataFrame:
    """Classes, functions and methods of Python files with their last lines.

    A block ends before the next line that is indented no more; a def directly in a class is a method.
    """
    rows = lines(files.where(F.col("path").endswith(".py"))).where(F.trim("line") != "").withColumn("indent", F.length(F.regexp_extract("line", r"^([ \t]*)", 1)))
    head = r"^[ \t]*(?:async\s+)?(class|def)\s+(\w+)"
    heads = rows.where(F.col("line").rlike(head)).select("repo_url", "path", "n", "indent", F.regexp_extract("line", head, 1).alias("word"), F.regexp_extract("line", head, 2).alias("name"))
    after = rows.select("repo_url", "path", F.col("n").alias("m"), F.col("indent").alias("i"))
    ends = heads.join(after, ["repo_url", "path"]).where("m > n and i <= indent").groupBy("repo_url", "path", "n").agg(F.min("m").alias("next"))
    last = rows.groupBy("repo_url", "path").agg((F.max("n") + 1).alias("eof"))
    spans = heads.join(ends, ["repo_url", "path", "n"], "left").join(last, ["repo_url", "path"]).withColumn("end", F.coalesce("next", "eof"))
    owner = spans.where("word = 'class'").select("repo_url", "path", F.col("n").alias("cn"), F.col("end").alias("cend"), F.col("name").alias("class"), F.col("indent").alias("ci"))
    inside = spans.join(owner, ["repo_url", "path"]).where("n > cn and n < cend and indent > ci").groupBy("repo_url", "path", "n").agg(F.max_by("class", "cn").alias("class"))
    kind = F.when(F.col("word") == "class", "Class").when(F.col("class").isNotNull(), "Method").otherwise("Function")
    return spans.join(inside, ["repo_url", "path", "n"], "left").select("repo_url", "path", "name", kind.alias("kind"), "class", (F.col("n") + 1).alias("line_start"), F.col("end").alias("line_end"))


def leaves(files: DataFrame, depth: int = 12) -> DataFrame:
    """Leaf values of YAML (all documents) and JSON files as dotted and bracketed paths; broken files give no rows."""

    @F.pandas_udf("array<struct<key:string,value:string>>")
    def run(content):
        import yaml

        def walk(x, at, level):
            if level > depth:
                return
            if isinstance(x, dict):
                for k, v in x.items():
                    yield from walk(v, f"{at}.{k}" if at else str(k), level + 1)
            elif isinstance(x, list):
                for i, v in enumerate(x):
                    yield from walk(v, f"{at}[{i}]", level + 1)
            elif x is not None:
                yield {"key": at, "value": str(x).lower() if isinstance(x, bool) else str(x)}

        def of(text):
            try:
                return [leaf for d in yaml.safe_load_all(text or "") for leaf in walk(d, "", 0)]
            except (yaml.YAMLError, ValueError, RecursionError):
                return []

        return content.map(of)

    wanted = files.where(F.col("path").rlike(r"\.(?:ya?ml|json)$"))
    return wanted.select("repo_url", "path", F.explode(run("content")).alias("l")).select("repo_url", "path", "l.key", "l.value")


def config_keys(files: DataFrame) -> DataFrame:
    """Config leaves with secrets marked, and the environment variables of ${NAME:default} placeholders."""
    rows = leaves(files)
    env = rows.select("repo_url", "path", F.explode(F.regexp_extract_all("value", F.lit(r"\$\{([A-Z_][A-Z0-9_]*)(?::[^}]*)?\}"), F.lit(1))).alias("key"), F.lit("env").alias("kind"))
    own = rows.select("repo_url", "path", "key", F.lit("app").alias("kind"))
    return own.unionByName(env).distinct().withColumn("is_secret", secret_key(F.col("key")))


def ci_variables(files: DataFrame) -> DataFrame:
    """Variables of CI files: ${{ secrets.X }}, ${{ vars.X }} and keys below `variables:`."""
    pattern = r"\$\{\{\s*(secrets|vars)\.(\w+)\s*\}\}"
    pair = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("s"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("k"))
    a = files.select("repo_url", "path", F.explode(pair).alias("p")).select("repo_url", "path", F.col("p.k").alias("key"), (F.col("p.s") == "secrets").alias("is_secret"))
    b = leaves(files).where(F.col("key").rlike(r"(?:^|\.)variables\.[A-Za-z_]\w*$")).select("repo_url", "path", F.regexp_extract("key", r"variables\.(\w+)$", 1).alias("key")).withColumn("is_secret", secret_key(F.col("key")))
    return a.unionByName(b).distinct()


def openapi_operations(files: DataFrame) -> DataFrame:
    """Operations of OpenAPI and Swagger files: method, route, operation_id."""

    @F.pandas_udf("array<struct<method:string,route:string,operation_id:string>>")
    def run(content):
        import yaml

        verbs = ("get", "post", "put", "patch", "delete", "head", "options")

        def of(text):
            try:
                spec = yaml.safe_load(text or "")
            except (yaml.YAMLError, ValueError, RecursionError):
                return []
            if not isinstance(spec, dict) or not ({"openapi", "swagger"} & spec.keys()) or not isinstance(spec.get("paths"), dict):
                return []
            return [{"method": m.upper(), "route": str(p), "operation_id": (o or {}).get("operationId")} for p, ops in spec["paths"].items() if isinstance(ops, dict) for m, o in ops.items() if m in verbs and isinstance(o or {}, dict)]

        return content.map(of)

    wanted = files.where(F.col("path").rlike(r"\.(?:ya?ml|json)$"))
    return wanted.select("repo_url", "path", F.explode(run("content")).alias("o")).select("repo_url", "path", "o.*")


def rpc_routes(files: DataFrame) -> DataFrame:
    """gRPC methods as /Service/Method and GraphQL root fields as /graphql/field."""
    service, rpc = r"(?s)service\s+(\w+)\s*\{(.*?)\n\}", r"\brpc\s+(\w+)"
    pair = F.arrays_zip(F.regexp_extract_all("content", F.lit(service), F.lit(1)).alias("s"), F.regexp_extract_all("content", F.lit(service), F.lit(2)).alias("b"))
    grpc = files.where(F.col("path").endswith(".proto")).select("repo_url", "path", F.explode(pair).alias("p")).select("repo_url", "path", F.lit("RPC").alias("method"), F.col("p.s").alias("s"), F.explode(F.regexp_extract_all("p.b", F.lit(rpc), F.lit(1))).alias("m"))
    root = r"(?s)type\s+(Query|Mutation|Subscription)\s*\{(.*?)\}"
    q = F.arrays_zip(F.regexp_extract_all("content", F.lit(root), F.lit(1)).alias("s"), F.regexp_extract_all("content", F.lit(root), F.lit(2)).alias("b"))
    graphql = files.where(F.col("path").rlike(r"\.(?:graphql|gql)$")).select("repo_url", "path", F.explode(q).alias("p")).select("repo_url", "path", F.upper("p.s").alias("method"), F.explode(F.regexp_extract_all("p.b", F.lit(r"(?m)^\s*(\w+)\s*[(:]"), F.lit(1))).alias("m"))
    a = grpc.select("repo_url", "path", "method", F.concat(F.lit("/"), "s", F.lit("/"), "m").alias("route"))
    return a.unionByName(graphql.select("repo_url", "path", "method", F.concat(F.lit("/graphql/"), "m").alias("route")))


def service_boundaries(files: DataFrame) -> DataFrame:
    """Service directories of each repository by the first strategy that finds some: two or more package.json, Dockerfiles, the whole repository."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    p = files.where(F.col("path").rlike(r"(?:^|/)package\.json$")).select("repo_url", folder.alias("directory"), F.lit(1).alias("rank"))
    nested = p.where("directory <> ''")
    many = nested.join(nested.groupBy("repo_url").count().where("count >= 2").select("repo_url"), "repo_url", "left_semi")
    docker = files.where(F.col("path").rlike(r"(?:^|/)Dockerfile$")).select("repo_url", folder.alias("directory"), F.lit(2).alias("rank"))
    whole = files.select("repo_url").distinct().select("repo_url", F.lit("").alias("directory"), F.lit(3).alias("rank"))
    rows = many.unionByName(docker).unionByName(whole)
    best = rows.groupBy("repo_url").agg(F.min("rank").alias("rank"))
    how = F.when(F.col("rank") == 1, "package_json").when(F.col("rank") == 2, "dockerfile").otherwise("fallback")
    return rows.join(best, ["repo_url", "rank"]).select("repo_url", "directory", how.alias("detection_method")).distinct()


def helm_values(files: DataFrame) -> DataFrame:
    """Leaves of Helm values files: references to secret stores as SecretRef with their vendor, others as ConfigKey."""
    from graphloom.functions.text import secret_vendor

    rows = leaves(files.where(F.col("path").rlike(r"(?:^|/)values[^/]*\.ya?ml$")))
    vendor = secret_vendor(F.col("value"))
    reference = (vendor != "UNKNOWN") | F.col("value").rlike(r"(?i)\$\{?\s*secrets?\.")
    return rows.select("repo_url", "path", "key", F.when(reference, "SecretRef").otherwise("ConfigKey").alias("label"), F.when(reference, vendor).alias("vendor"))


def k8s_config(files: DataFrame) -> DataFrame:
    """Config and secret keys of Kubernetes manifests: kind of source, object name, key, whether secret.

    ConfigMap and Secret data, and env and envFrom of all containers, however deep (CronJobs too).
    """

    @F.pandas_udf("array<struct<source:string,name:string,key:string,is_secret:boolean>>")
    def run(content):
        import yaml

        def containers(x):
            if isinstance(x, dict):
                for k, v in x.items():
                    if k in ("containers", "initContainers") and isinstance(v, list):
                        yield from (c for c in v if isinstance(c, dict))
                    else:
                        yield from containers(v)
            elif isinstance(x, list):
                for v in x:
                    yield from containers(v)

        def facts_of(d):
            name = str((d.get("metadata") or {}).get("name", ""))
            if d.get("kind") in ("ConfigMap", "Secret"):
                secret = d["kind"] == "Secret"
                for part in ("data", "stringData"):
                    for key in d.get(part) or {}:
                        yield {"source": d["kind"], "name": name, "key": str(key), "is_secret": secret}
            for c in containers(d.get("spec")):
                for e in c.get("env") or []:
                    if isinstance(e, dict) and "name" in e:
                        yield {"source": "env", "name": name, "key": str(e["name"]), "is_secret": "secretKeyRef" in (e.get("valueFrom") or {})}
                for e in c.get("envFrom") or []:
                    for ref in ("configMapRef", "secretRef"):
                        if isinstance(e, dict) and ref in e:
                            yield {"source": "envFrom", "name": name, "key": str((e[ref] or {}).get("name", "")), "is_secret": ref == "secretRef"}

        def of(text):
            try:
                return [f for d in yaml.safe_load_all(text or "") if isinstance(d, dict) for f in facts_of(d)]
            except (yaml.YAMLError, ValueError, RecursionError, AttributeError):
                return []

        return content.map(of)

    wanted = files.where(F.col("path").rlike(r"\.ya?ml$") & F.col("content").contains("kind:"))
    return wanted.select("repo_url", "path", F.explode(run("content")).alias("f")).select("repo_url", "path", "f.*")


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    """Nodes and DEFINES edges' ends of symbols: id, label, name, file_id."""
    prefix = F.when(F.col("kind") == "Class", "cls").when(F.col("kind") == "Method", "method").otherwise("fn")
    node = F.concat(F.col("repo_url"), F.lit(":"), prefix, F.lit(":"), F.col("path"), F.lit(":"), F.col("name"), F.lit("@"), F.col("line_start").cast("string"))
    return symbols.select(node.alias("id"), F.col("kind").alias("label"), "name", F.concat_ws(":", "repo_url", "path").alias("file_id"))


def topic_graph(files: DataFrame) -> DataFrame:
    """Topic nodes, each once, with how many files produce and consume it."""
    rows = topics(files)
    return rows.groupBy(F.concat(F.lit("topic:"), "topic").alias("id")).agg(F.count_if(F.col("kind") == "produce").alias("producers"), F.count_if(F.col("kind") == "consume").alias("consumers"))


def extraction(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a set of files in one plan; the first of equal nodes and edges stays."""
    file_nodes = files.select(F.concat_ws(":", "repo_url", "path").alias("id"), F.lit("File").alias("label"), F.col("path").alias("name"))
    edges = import_edges(files)
    kinds = F.when(F.col("type") == "USES", "Database").when(F.col("type") == "READS_CONFIG", "Config").when(F.col("type") == "IMPORTS", "Module").otherwise("Topic")
    targets = edges.select(F.col("dst").alias("id"), kinds.alias("label"), F.regexp_extract("dst", "([^:]*)$", 1).alias("name"))
    facts_of = typescript_facts(files)
    symbols = symbol_nodes(python_symbols(files)).select("id", "label", "name").unionByName(facts_of.where("id is not null").select("id", F.col("kind").alias("label"), "name"))
    edges = edges.unionByName(facts_of.where("target is not null").select(F.col("owner").alias("src"), F.col("target").alias("dst"), F.col("kind").alias("type")), allowMissingColumns=True)
    return file_nodes.unionByName(targets).unionByName(symbols).dropDuplicates(["id"]), edges.dropDuplicates(["src", "dst", "type"])
