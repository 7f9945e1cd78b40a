"""Near-duplicates of the pipeline against all pairs."""

import random

import corpus_pipeline
from graphloom.llm import near_duplicates
from graphloom.llm.common import documents


def brute(texts: dict) -> set:
    """Ids kept: the smallest of each group connected by five-word Jaccard >= 0.8."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    group, changed = {i: i for i in sets}, True
    links = {i: [j for j in sets if near(sets[i], sets[j])] for i in sets}
    while changed:
        new = {i: min(group[j] for j in links[i]) for i in sets}
        changed, group = new != group, new
    return {i for i in sets if group[i] == i}


def stage(spark, docs):
    return dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, None)


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(12)
    texts = {}
    for base in range(12):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 40, 200, 600]))]
        for _ in range(8):
            texts[rng.randrange(10**6)] = " ".join(words)
            words = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 50)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    texts |= {-1: None, -2: "", -3: " \n"}
    got = [r["doc_id"] for r in stage(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute(texts))


def test_stage_on_tables(spark, sf):
    docs = documents(spark, sf)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in stage(spark, docs).collect()) == sorted(brute(texts))


def test_keep_one_of_odd_rows(spark, odd_docs):
    kept = near_duplicates.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    assert ids == sorted([(False, x) for x in (-3, 1, 3, 5, 6, 7, 8, 10)] + [(True, 0)])
