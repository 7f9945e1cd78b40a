"""Source-file and log scans as DataFrames files(repo_url, path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 2 * 1024 * 1024
# Directories, file names and endings that a scan leaves out; languages by ending.
IGNORED_DIRS = (
    "node_modules", "dist", "build", "coverage", ".next", ".nuxt", ".cache", ".turbo", ".vercel", ".output", ".git", ".github", ".gitlab", ".idea", ".vscode",
    "__pycache__", ".venv", "venv", "env", ".tox", ".pytest_cache", ".mypy_cache", ".ruff_cache", "site-packages", "eggs", ".eggs",
    "target", ".gradle", ".m2", "out", "classes", "generated", "vendor", "Cargo.lock.d", "tmp", "temp", "logs", ".terraform",
)
IGNORED_ENDINGS = (".min.js", ".min.css", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "go.sum", "cargo.lock")
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "pyi": "python", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "rs": "rust", "rb": "ruby", "cs": "csharp", "php": "php", "scala": "scala", "swift": "swift", "sql": "sql",
    "prisma": "prisma", "proto": "proto", "graphql": "graphql", "gql": "graphql", "md": "markdown", "yml": "yaml", "yaml": "yaml", "json": "json", "env": "dotenv",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), extension(path))


def skip_reason(path: Column, size: Column) -> Column:
    """Why a scan leaves a file out; null if it stays."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    ignored = F.exists(dirs, lambda d: d.isin(*IGNORED_DIRS) | d.startswith("."))
    ending = F.lower(path).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in IGNORED_ENDINGS) + ")$")
    return F.when(ignored, "directory").when(ending, "generated").when(language(path).isNull(), "extension").when(size > MAX_BYTES, "size")


def scan(spark: SparkSession, root: str, repo_url: str) -> tuple[DataFrame, DataFrame]:
    """(files, skip counts) below a folder of any Hadoop file system."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = raw.select(F.lit(repo_url).alias("repo_url"), F.regexp_replace("path", r"^.*?" + root.rstrip("/").split("/")[-1] + "/", "").alias("path"), F.col("length").alias("size"), "content")
    marked = rows.withColumn("reason", skip_reason(F.col("path"), F.col("size")))
    kept = marked.where("reason is null").select("repo_url", "path", "size", language(F.col("path")).alias("language"), F.col("content").cast("string").alias("content"))
    return kept, marked.where("reason is not null").groupBy("reason").count()


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two manifests (path, hash): added, changed and deleted paths."""
    both = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def discover(repos: DataFrame, max_mb: int = 500) -> DataFrame:
    """Repositories once by id, neither archived nor too large."""
    return repos.dropDuplicates(["id"]).where((F.col("size_mb") <= max_mb) & ~F.coalesce("archived", F.lit(False)))


def git_log(logs: DataFrame, marker: str = "@@commit@@", most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(commits, touched) of logs(repo_url, raw): blocks after `marker`, a header of fields parted by 0x1F, then paths."""
    blocks = logs.select("repo_url", F.explode(F.split("raw", marker)).alias("block")).where(F.trim("block") != "")
    head = F.split(F.split_part("block", F.lit("\n"), F.lit(1)), "\x1f")
    rows = blocks.withColumn("h", head).where(F.size("h") >= 5)
    commits = rows.select(
        "repo_url", F.col("h")[0].alias("sha"), F.col("h")[1].alias("author"), F.col("h")[2].alias("author_email"), F.col("h")[3].alias("authored_at"),
        F.substring(F.col("h")[4], 1, most).alias("message"), F.filter(F.split(F.coalesce(F.try_element_at("h", F.lit(6)), F.lit("")), " "), lambda s: s != "").alias("parent_shas"),
    )
    files = rows.select("repo_url", F.col("h")[0].alias("sha"), F.explode(F.slice(F.split("block", "\n"), 2, 1_000_000)).alias("path"))
    return commits, files.withColumn("path", F.trim("path")).where("path <> ''")


def last_changed(commits: DataFrame, touched: DataFrame) -> DataFrame:
    """Newest date per file."""
    return touched.join(commits.select("repo_url", "sha", "authored_at"), ["repo_url", "sha"]).groupBy("repo_url", "path").agg(F.max("authored_at").alias("last_changed"))


def history_edges(touched: DataFrame, files: DataFrame) -> DataFrame:
    """TOUCHED edges from commits to known files; `skipped` counts belong to the caller's left join."""
    ids = files.select("repo_url", "path", F.concat_ws(":", "repo_url", "path").alias("dst"))
    return touched.join(ids, ["repo_url", "path"], "left").select(F.concat_ws("#", "repo_url", "sha").alias("src"), "dst", F.lit("TOUCHED").alias("type"))
