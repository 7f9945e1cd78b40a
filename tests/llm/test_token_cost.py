"""Encoding costs and limits: words that never come back, white space without end, what a task loads."""

import random
import time

import numpy as np

from graphloom.llm import packing, tokens


def _spent(f, texts) -> float:
    """CPU seconds of f over `texts`, the least of three."""
    least = float("inf")
    for _ in range(3):
        began = time.process_time()
        for x in texts:
            f(x)
        least = min(least, time.process_time() - began)
    return least


def test_new_words_cost_less_than_by_the_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(5, 12)))
    texts = [" ".join(word() for _ in range(500)) for _ in range(800)]
    path = tokens.tokenizer_path()
    exact = Tokenizer.from_file(path)
    encode, dtype = tokens.encoder(path)
    for x in texts[:20]:
        assert np.frombuffer(encode(x), dtype).tolist() == exact.encode(x, add_special_tokens=False).ids
    assert _spent(encode, texts) < 0.6 * _spent(lambda x: exact.encode(x, add_special_tokens=False), texts)


def test_the_tokenizer_is_loaded_for_texts_that_need_it(monkeypatch):
    import tokenizers

    loaded = []
    real = tokenizers.Tokenizer

    class Noted:
        @staticmethod
        def from_file(path):
            loaded.append(path)
            return real.from_file(path)

    monkeypatch.setattr(tokenizers, "Tokenizer", Noted)
    encode, dtype = tokens.encoder(tokens.tokenizer_path())
    encode("plain text")
    assert not loaded
    assert [np.frombuffer(encode(x), dtype).tolist()[-1] for x in ("a<|endoftext|>",) * 2] == [50256] * 2 and len(loaded) == 1


def test_white_space_without_end(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokens.tokenizer_path())
    texts = [" " * 1_200_000 + "x", "a" + "\n" * 1_200_000 + " b"]
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).groupBy("doc_id").sum("length").collect()
    assert dict(map(tuple, rows)) == {i: len(exact.encode(x, add_special_tokens=False).ids) + 1 for i, x in enumerate(texts)}
