"""Exact token ids, and length statistics from an exact histogram.

encoder(path) gives the ids of the byte-level BPE tokenizer file at `path`. Where the file's
merges are ranked as its vocabulary is numbered, whole texts go through `tiktoken` over the same
vocabulary; other files, texts in which an added token of the file stands, and texts that its
pre-tokenizer gives up on take the tokenizer as it is.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import documents, map_texts, materialize

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str):
    """Function text -> bytes of its ids, each a little-endian unsigned 32-bit number.

    Returns (function, numpy dtype of the ids). The tokenizer itself is loaded for the first text that needs it.
    """
    import json

    import numpy as np

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    dtype = np.dtype("<u4")
    ranks_first = len(vocabulary) - len(merges)
    ids = sorted(vocabulary[a + b] for a, b in merges)
    ranked = [vocabulary[a + b] for a, b in merges] == ids and bool(ids) and ids[0] >= 256 and ids[-1] - ids[0] == len(ids) - 1
    pre = spec.get("pre_tokenizer") or {}

    @cache
    def whole():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def plainly(text: str) -> bytes:
        return np.array(whole().encode(text, add_special_tokens=False).ids, dtype).tobytes()

    if not ranked or ranks_first > 257 or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return plainly, dtype

    import tiktoken

    byte_of = _byte_of()
    added = [x["content"] for x in spec.get("added_tokens", ())]
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in added}
    encode = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def run(text: str) -> bytes:
        if any(x in text for x in added):
            return plainly(text)
        try:
            return encode(text, disallowed_special=()).astype(dtype, copy=False).tobytes()
        except ValueError:  # white space of about a million characters on end
            return plainly(text)

    return run, dtype


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row of `docs(doc_id, text)`; null and empty texts have 0."""
    path = path or tokenizer_path()

    def make():
        encode, dtype = encoder(path)
        return lambda text: (len(encode(text or "")) // dtype.itemsize,)

    return map_texts(docs, make, "n_tokens long")


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many rows of `docs` have each encoded length."""
    return token_counts(docs, path).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_table(histogram: DataFrame, step: int = 1024) -> DataFrame:
    """Suffix sums of a histogram(n_tokens, n_docs), a row per length that occurs.

    docs_longer, tokens_longer: documents above this length and their tokens; docs_upto: the
    rest; tokens_kept: total tokens if every document is cut at this length; share_upto: the
    length's quantile position. An empty histogram gives no rows. Lengths are summed in ranges
    of `step`, and only the ranges' totals meet in one task.
    """
    h = materialize(histogram, "lengths").withColumn("range", F.floor(F.col("n_tokens") / step)).withColumn("t", F.col("n_tokens") * F.col("n_docs"))
    total = h.groupBy("range").agg(F.sum("n_docs").alias("rd"), F.sum("t").alias("rt"))
    over = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = total.select("range", F.coalesce(F.sum("rd").over(over), F.lit(0)).alias("ad"), F.coalesce(F.sum("rt").over(over), F.lit(0)).alias("at"), F.sum("rd").over(whole).alias("n"))
    inside = Window.partitionBy("range").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.col("ad") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))
    tokens = F.col("at") + F.coalesce(F.sum("t").over(inside), F.lit(0))
    rows = h.join(above, "range").select("n_tokens", "n_docs", "n", longer.alias("docs_longer"), tokens.alias("tokens_longer"))
    summed = rows.select("n_tokens", "n_docs", "docs_longer", "tokens_longer", (F.col("n") - F.col("docs_longer")).alias("docs_upto"), "n")
    return summed.join(F.broadcast(h.agg(F.sum("t").alias("all_tokens"))), how="cross").select(
        "n_tokens", "n_docs", "docs_upto", "docs_longer", "tokens_longer",
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("tokens_kept"),
        (F.col("docs_upto") / F.col("n")).alias("share_upto"),
    )


def tokens_at(table: DataFrame, limit: int) -> DataFrame:
    """One row (tokens_kept) for any context limit: total tokens if every document is cut at `limit`."""
    below = table.where(F.col("n_tokens") <= limit).agg(F.max_by(F.struct("docs_longer", "tokens_longer", "tokens_kept", "n_tokens"), "n_tokens").alias("x"))
    first = table.agg(F.min_by(F.struct((F.col("docs_upto") + F.col("docs_longer")).alias("n")), "n_tokens").alias("y"))
    return below.crossJoin(first).select(
        F.coalesce(F.expr(f"x.tokens_kept + x.docs_longer * ({limit} - x.n_tokens)"), F.expr(f"y.n * {limit}"), F.lit(0)).cast("long").alias("tokens_kept")
    )


def quantile(table: DataFrame, p: float) -> DataFrame:
    """One row (n_tokens): the smallest length that at least a share p of the documents does not exceed."""
    return table.where(F.col("share_upto") >= p - 1e-12).agg(F.min("n_tokens").alias("n_tokens"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents with its suffix sums, a row per length that occurs."""
    return context_table(length_histogram(documents(spark, sf_dir)))
