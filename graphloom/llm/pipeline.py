"""Stages of the corpus pipeline, each over all rows that its predecessor kept.

Each takes (spark, docs, sf_dir) and returns a DataFrame, which has to be written before the next
stage is called: a stage removes the scratch tables that earlier ones have left. All but the last
return the columns of `docs`, extra ones included, whatever their names. Nulls may stand in any
column; rows without doc_id and repeated rows are rows like others unless a stage says so; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, near_duplicates, packing, pii, toxicity
from graphloom.llm.common import discard, documents, materialize, stage_scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, fitted on the labels of these documents, scores under one half.

    Null and empty texts score as clean; without usable labels nothing is dropped; equal texts
    share their score, so repeated rows stay or go together.
    """
    with stage_scratch(spark):
        return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that a five-word Jaccard similarity of 0.8 or more links.

    The row of the smallest doc_id stays (of equal ids and of rows without any, one). Null, empty
    and blank texts form one group.
    """
    with stage_scratch(spark):
        return near_duplicates.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item stands, within its edit budget.

    Null and empty texts stay; null and empty items match nothing; repeated rows stay or go together.
    """
    with stage_scratch(spark):
        return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts replaced by its kind; null and empty texts stay as they are."""
    with stage_scratch(spark):
        return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their sequences and places; a null or empty text is one token, each repeated row its own document."""
    with stage_scratch(spark):
        return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack),
]

#: Models, edit distances and token ids are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; the result of each is written and read again, the last is returned."""
    docs, written = documents(spark, sf_dir), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            before, written = written, materialize(docs, f"pipeline-{name}")
            docs = written
            if before is not None:
                discard(before)
    return docs
