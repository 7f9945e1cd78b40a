"""BM25 with stemming: only candidates are stemmed, and no term of a stem is missed."""

import itertools
import random

from graphloom.functions.porter import STEP2, STEP3, STEP4, stem
from graphloom.operators import search as s


def test_stems_share_all_but_two_characters_with_their_terms():
    tails = ["", "s", "es", "ies", "sses", "ed", "eed", "ing", "y", "e", "ll", *STEP2, *STEP3, *STEP4]
    draw = random.Random(7)
    heads = ["".join(draw.choice("abeiloprstuyzé") for _ in range(n)) for n in range(1, 8) for _ in range(60)]
    for word in (h + a + b for h in heads for a, b in itertools.product(tails, tails)):
        assert word.startswith(stem(word)[:-2]), word


def test_only_candidates_are_stemmed(spark, monkeypatch):
    texts = ["Licensing and licensed licenses", "other words only", None, "a licence, ponies licens license-plate", "the poni", "license plates x license y plate"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    sent = spark.sparkContext.accumulator(0)
    kept = s.stemmed

    def stemmed(rows, column):
        sent.add(rows.selectExpr(f"sum(size(filter({column}, t -> t <> '')))").first()[0])
        return kept(rows, column)

    monkeypatch.setattr(s, "stemmed", stemmed)
    hits = {r["key"] for r in s.bm25(docs, "doc_id", ["text"], "licensing pony").collect()}
    assert hits == {0, 3, 4, 5} and sent.value < sum(len((t or "").split()) for t in texts)
    assert {r["key"] for r in s.bm25(docs, "doc_id", ["text"], "license-plates").collect()} == {3, 5}
