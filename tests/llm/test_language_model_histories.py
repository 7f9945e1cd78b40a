"""Every history has its own counts, whatever fits into the broadcast vocabulary."""

import random

import pytest

from graphloom.llm import language_model


def test_rare_histories_keep_their_context(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[: rng.choice([4, 20, 60])]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = []
    for head, classes in ((3, 6), (3, 1000)):
        for name, value in (("HEAD", head), ("CLASSES", classes), ("TOKENS_A_TASK", 300), ("BLOCK_TOKENS", 200)):
            monkeypatch.setattr(language_model, name, value)
        found.append({r["doc_id"]: r["score"] for r in language_model.score_documents(docs, docs.doc_id % 4 != 0).collect()})
    assert found[0] == pytest.approx(found[1])
