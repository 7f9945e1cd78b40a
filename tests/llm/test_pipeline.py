"""Stages of the corpus pipeline against brute-force versions."""

import re

import corpus_pipeline
from graphloom.llm import decontaminate, toxicity
from graphloom.llm.common import documents, materialize
from tests.llm.test_near_duplicates import brute


def test_stages(spark, sf):
    docs = documents(spark, sf)
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
        now = {r["doc_id"]: r.asDict().get("text") for r in docs.collect()}
        if name == "toxicity":
            score = toxicity.scorer(toxicity.fit(before, labels))
            assert now.keys() == {i for i, t in kept.items() if score(t)[0] < 0.5}
        elif name == "near_duplicates":
            assert now.keys() == brute(kept)
        elif name == "decontamination":
            items = [(r["item_id"], decontaminate.words_of(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            found = {i for i, t in kept.items() if any(decontaminate.myers_search(decontaminate.masks_of(w), len(w), decontaminate.words_of(t))[0] <= decontaminate.edit_budget(len(w)) for _, w in items if w)}
            assert now.keys() == kept.keys() - found
        elif name == "pii":
            assert now.keys() == kept.keys() and not any(re.search(r"[a-z0-9]@[a-z0-9-]+\.[a-z]", t) for t in now.values())
        else:
            assert now.keys() == kept.keys()
        kept = now


def test_odd_tables(spark, tables, clashing):
    """Nulls, odd texts and repeated rows, without and with columns that bear every name used inside."""
    assert corpus_pipeline.run(spark, tables).count() > 0
    docs = documents(spark, clashing)
    for name, stage in corpus_pipeline.STAGES:
        found = materialize(stage(spark, docs, clashing), f"test-{name}")
        if name != "packing":
            assert found.columns == docs.columns and found.count() > 0
            assert {r[0] for r in found.select("spans").distinct().collect()} == {"clash"}
            docs = found


def test_empty_tables(spark, tables, clashing, tmp_path):
    for x in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{x}.parquet").limit(0).write.parquet(f"{tmp_path}/{x}.parquet")
    docs = documents(spark, clashing)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
