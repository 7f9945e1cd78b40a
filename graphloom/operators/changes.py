"""Merge requests and line authorship: diff statistics by risk, files by churn, risks, blamed ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a path touches, and words of a breaking change.
RISK_PATHS = (
    ("migration", r"(^|/)(migrations?|db/migrations?|schema|liquibase|flyway)/"), ("helm", r"(?i)(^|/)(helm|charts?|deploy|values\.ya?ml)"),
    ("k8s", r"(?i)(^|/)(k8s|kubernetes|manifests?)/"), ("ci", r"\.gitlab-ci\.ya?ml|\.github/workflows/"), ("dockerfile", r"(^|/)Dockerfile($|\.)"),
    ("terraform", r"\.tf$"), ("secrets", r"(?i)(^|/)(secrets?|vault|\.env)"),
)
BREAKING = ("breaking change", "force-push", "!:", "remove api", "rename column")
TOP_FILES, MANY_FILES, MANY_LINES = 15, 50, 1500


def risk_tags(path: Column) -> Column:
    """What a path touches, in the table's order."""
    return F.array_compact(F.array(*(F.when(path.rlike(p), tag) for tag, p in RISK_PATHS)))


def file_churn(changes: DataFrame) -> DataFrame:
    """changes(mr, path, diff): mr, path, added, removed, tags; a null diff has no lines, file headers do not count."""
    lines = F.split(F.coalesce("diff", F.lit("")), "\n")
    of = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))
    return changes.select("mr", "path", of("+").alias("added"), of("-").alias("removed"), risk_tags(F.col("path")).alias("tags"))


def tag_counts(churn: DataFrame) -> DataFrame:
    """Files of each merge request that touch a tag: mr, tag, files."""
    return churn.select("mr", F.explode("tags").alias("tag")).groupBy("mr", "tag").agg(F.count(F.lit(1)).alias("files"))


def top_files(churn: DataFrame, most: int = TOP_FILES) -> DataFrame:
    """The `most` files of each merge request with most changed lines: mr, place (from 1), path, added, removed; ties by path."""
    order = Window.partitionBy("mr").orderBy(F.desc(F.col("added") + F.col("removed")), "path")
    return churn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("mr", "place", "path", "added", "removed")


def merge_risks(requests: DataFrame, churn: DataFrame) -> DataFrame:
    """requests(mr, title, description, draft, has_conflicts, pipeline, approvals_left, approvers) with `risks`, in a fixed order.

    Null flags are false; without approval data (null) nothing is said of approvals; a request
    without changed files has no risks of size or paths.
    """
    sums = churn.groupBy("mr").agg(
        F.count(F.lit(1)).alias("files"), F.sum("added").alias("plus"), F.sum("removed").alias("minus"),
        *(F.count_if(F.array_contains("tags", tag)).alias(f"n_{tag}") for tag, _ in RISK_PATHS),
    )
    told = F.lower(F.concat_ws("\n", "title", F.coalesce("description", F.lit(""))))
    risks = [
        F.when(F.col("files") > MANY_FILES, F.format_string("large MR: %d files changed", "files")),
        F.when(F.col("plus") + F.col("minus") > MANY_LINES, F.format_string("large diff: +%d/-%d lines", "plus", "minus")),
        F.when(F.col("draft"), "draft"),
        F.when(F.col("has_conflicts"), "has merge conflicts"),
        F.when(F.col("pipeline").rlike("failed|canceled"), F.concat(F.lit("latest pipeline status="), "pipeline")),
        F.when(F.col("approvals_left") > 0, F.format_string("approvals_left=%d", "approvals_left")),
        F.when(F.col("approvers") == 0, "no approvers yet"),
        *(F.when(F.col(f"n_{t}") > 0, F.format_string(f"touches {t} (%d file%s)", f"n_{t}", F.when(F.col(f"n_{t}") > 1, "s").otherwise(""))) for t, _ in RISK_PATHS),
        F.coalesce(*(F.when(F.contains(told, F.lit(w)), f'description mentions "{w}"') for w in BREAKING)),
    ]
    return requests.join(sums, "mr", "left").select(*requests.columns, F.array_compact(F.array(*risks)).alias("risks"))


def blame_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """lines(path, line, sha, author) within ranges(path, first, last), runs of one commit folded.

    Rows: path, first, last (of the range), from_line, to_line, sha, author. Ranges that end before
    they start, and files that are not known, give no rows; equal ranges count once.
    """
    asked = ranges.where("first <= last").select("path", "first", "last").distinct()
    hit = lines.join(asked, "path").where("line between first and last")
    key = Window.partitionBy("path", "first", "last").orderBy("line")
    new = F.coalesce((F.lag("sha").over(key) != F.col("sha")).cast("int"), F.lit(1))
    runs = hit.withColumn("new", new).withColumn("run", F.sum("new").over(key))
    return runs.groupBy("path", "first", "last", "run").agg(F.min("line").alias("from_line"), F.max("line").alias("to_line"), F.first("sha").alias("sha"), F.first("author").alias("author")).drop("run")
