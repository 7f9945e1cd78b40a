"""Change-event ingestion with Structured Streaming.

The same column expressions serve batch and stream; only the source and sink differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import glob_any
from graphloom.scratch import folder

PUSH_SCHEMA = "ref string, before string, after string, total_commits_count int, project struct<path_with_namespace:string,web_url:string,default_branch:string>"
NO_SHA = "0" * 40


def push_status(body: Column, token: Column, secret: str, allowed: list[str], max_bytes: int = 1_048_576) -> Column:
    """HTTP status of a push request: 401 wrong token, 413 too large, 400 no JSON object, 403 not allowed, 200 skipped, 202 accepted."""
    push = F.from_json(body, PUSH_SCHEMA)
    return (
        F.when(~F.coalesce(token == secret, F.lit(False)), 401)
        .when(F.octet_length(body) > max_bytes, 413)
        .when(push.isNull() | push["ref"].isNull() | push["project"]["path_with_namespace"].isNull(), 400)
        .when(~glob_any(push["project"]["path_with_namespace"], allowed), 403)
        .when(skip_reason(push).isNotNull(), 200)
        .otherwise(202)
    )


def skip_reason(push: Column) -> Column:
    return F.when(~push["ref"].startswith("refs/heads/"), "not_a_branch").when(push["before"] == NO_SHA, "new_branch").when(push["total_commits_count"] == 0, "no_commits")


def ingest_mode(head: Column, last: Column, changed: Column, limit: int = 100) -> Column:
    """skip if nothing is new, full if there is no last state, its changes are unknown or too many, else incremental."""
    return F.when(head == last, "skip").when(last.isNull() | changed.isNull() | (changed > limit), "full").otherwise("incremental")


def deduplicated(stream: DataFrame, key: str, at: str, lateness: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark; state is dropped behind it."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, key: str, at: str, size: str, lateness: str = "10 minutes", slide: str | None = None) -> DataFrame:
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return timed.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def with_dead_letters(batch: DataFrame, work: Callable[[DataFrame], DataFrame], ok: Column) -> tuple[DataFrame, DataFrame]:
    """(done, dead letters) of a micro-batch: rows that fail the check go aside with their category."""
    marked = work(batch).withColumn("__ok", F.coalesce(ok, F.lit(False)))
    return marked.where("__ok").drop("__ok"), marked.where("not __ok").drop("__ok")


def replay(spark: SparkSession, path: str, schema: str, build: Callable[[DataFrame], DataFrame], name: str, files_per_batch: int = 1, mode: str = "append", only: str = "*") -> DataFrame:
    """Run a stream over the Parquet files of a folder (names like `only`) to its end and return the result table.

    Results and progress go to the shared folder: a batch that is run again overwrites its own
    output, and in complete mode the last batch holds everything. Backpressure is the number of
    files in a batch.
    """
    at = folder(spark, name)
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", only).parquet(path))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/{'all' if mode == 'complete' else number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/out/none")  # a stream without data has no batch
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/progress").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{at}/out")
