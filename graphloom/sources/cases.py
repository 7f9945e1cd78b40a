"""Evaluation cases: scan, run, and JSON lines sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.router import STRATEGIES, citation_overlap, classify

CASE_SCHEMA = "id string, question string, expectedClass string, goldCitations array<string>, tags array<string>"


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON array file; an unknown class or a missing id is an error."""
    cases = spark.read.schema(CASE_SCHEMA).json(path, multiLine=True)
    wrong = F.when(F.col("id").isNull() | F.col("question").isNull(), "id and question are needed").when(~F.coalesce(F.col("expectedClass").isin(*STRATEGIES), F.lit(False)), "unknown class")
    return cases.withColumn("id", F.when(wrong.isNull(), F.col("id")).otherwise(F.raise_error(F.concat_ws(": ", wrong, "id"))))


def run_cases(cases: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """Per case: predicted class, whether right, and the overlap of retrieved(id, citations) with its gold citations."""
    rows = classify(cases, "question")
    rows = rows.join(retrieved, "id", "left") if retrieved is not None else rows.withColumn("citations", F.expr("cast(array() as array<string>)"))
    o = citation_overlap(F.coalesce("citations", F.expr("cast(array() as array<string>)")), F.col("goldCitations"))
    return rows.select("id", F.col("class").alias("predicted"), (F.col("class") == F.col("expectedClass")).alias("class_correct"), o.alias("o")).select("id", "predicted", "class_correct", "o.precision", "o.recall")


def write_lines(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)
