"""Full-text, vector and hybrid search."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.porter import stem
from graphloom.model import clamp
from graphloom.scratch import written

K1, B = 1.2, 0.75
RRF_K = 60


def terms_of(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_phrases(query: str) -> list[list[str]]:
    """A query's words as phrases: operators stripped, one-letter words dropped, `a-b` a two-term phrase."""
    words = [w for w in re.sub(r'["()*:^]', " ", query).split() if len(w) >= 2]
    return [p for w in words if (p := [t.lower() for t in re.split(r"[^\w]|_", w) if t])]


def stemmed(rows: DataFrame, column: str) -> DataFrame:
    """`column` (array of terms) with each term stemmed, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(x):
        seen: dict[str, str] = {}
        return x.map(lambda terms: [seen.get(t) or seen.setdefault(t, stem(t)) for t in terms])

    return rows.withColumn(column, run(column))


def _stem_in(term: Column, phrases: list[list[str]]) -> Column:
    """Whether a term may have one of the phrases' stems: stemming changes at most the last two characters of what it keeps."""
    heads = sorted({t[:-2] for p in phrases for t in p})
    return reduce(Column.__or__, (term.startswith(h) for h in heads))


def bm25(docs: DataFrame, key: str, columns: list[str], query: str, k: int = 50, stemming: bool = True) -> DataFrame:
    """The k best rows for any of the query's phrases: key, score.

    score = sum of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)); idf is
    floored at 1e-6. Texts are read once: each document's length and hits of the query's phrases
    are written, then aggregated for the corpus statistics and scored. Only terms that begin like
    a stem of the query are stemmed.
    """
    phrases = [[stem(t) for t in p] if stemming else p for p in query_phrases(query)]
    rows = docs.select(F.col(key).alias("key"), F.concat(*(terms_of(F.col(c)) for c in columns)).alias("terms"))
    if not phrases:
        return rows.select("key", F.lit(0.0).alias("score")).limit(0)
    rows = rows.withColumn("len", F.size("terms"))
    if stemming:
        single = all(len(p) == 1 for p in phrases)
        other = F.filter("terms", lambda t: _stem_in(t, phrases)) if single else F.transform("terms", lambda t: F.when(_stem_in(t, phrases), t).otherwise(""))
        rows = stemmed(rows.withColumn("terms", other), "terms")

    def frequency(p: list[str]) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("terms") - len(p) + 1, F.lit(1)))
        if len(p) == 1:
            return F.size(F.filter("terms", lambda t: t == p[0]))
        return F.size(F.filter(starts, lambda i: F.slice("terms", i, len(p)) == F.array(*(F.lit(t) for t in p))))

    counted = written(rows.select("key", "len", *(frequency(p).alias(f"tf{i}") for i, p in enumerate(phrases))), "counts")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases)))).first()
    if not stats["n"]:
        return rows.select("key", F.lit(0.0).alias("score")).limit(0)
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = max(1e-6, math.log((stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
        tf = F.col(f"tf{i}")
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(stats["mean"] or 1.0)))
    hit = F.greatest(*(F.col(f"tf{i}") for i in range(len(phrases))), F.lit(0)) > 0
    return counted.where(hit).select("key", score.alias("score")).orderBy(F.desc("score"), "key").limit(clamp(k, 1, 200))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a fixed vector; a zero vector scores 0."""
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = math.sqrt(sum(x * x for x in query))
    own = F.sqrt(dot(vector, vector))
    return F.when(own == 0, 0.0).otherwise(dot(vector, q) / (own * F.lit(norm)))


def vector_top_k(rows: DataFrame, key: str, vector: str, query: list[float], k: int = 10) -> DataFrame:
    """The k most similar rows of the query's dimension: key, score. A zero query finds nothing."""
    if not any(query):
        return rows.select(F.col(key).alias("key"), F.lit(0.0).alias("score")).limit(0)
    fitting = rows.where(F.size(vector) == len(query))
    return fitting.select(F.col(key).alias("key"), cosine(F.col(vector), query).alias("score")).orderBy(F.desc("score"), "key").limit(clamp(k, 1, 100))


def ranked(rows: DataFrame, source: str) -> DataFrame:
    """A leg's top list (bounded by its k) with ranks from 1."""
    return rows.select(F.lit(source).alias("source"), "key", "score", F.row_number().over(Window.orderBy(F.desc("score"), "key")).alias("rank"))


def rrf(legs: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (source, key, rank): key, score, sources; best first."""
    if k <= 0:
        raise ValueError("k must be positive")
    return legs.groupBy("key").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).orderBy(F.desc("score"), "key")


def hybrid(docs: DataFrame, key: str, columns: list[str], query: str, vectors: DataFrame, vector_key: str, vector: str, query_vector: list[float], k: int = 10, legs: int = 50, mode: str = "hybrid", stemming: bool = True) -> DataFrame:
    """Fused top k of the full-text and the vector leg; mode may ask for one leg alone."""
    parts = []
    if mode in ("hybrid", "bm25"):
        parts.append(ranked(bm25(docs, key, columns, query, legs, stemming), "bm25"))
    if mode in ("hybrid", "vector"):
        parts.append(ranked(vector_top_k(vectors, vector_key, vector, query_vector, legs), "vector"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    fused = both.groupBy("key").agg(
        F.sum(1 / (F.lit(RRF_K) + F.col("rank"))).alias("score"), F.max(F.when(F.col("source") == "bm25", F.col("score"))).alias("bm25_score"),
        F.max(F.when(F.col("source") == "vector", F.col("score"))).alias("vector_score"),
    )
    return fused.orderBy(F.desc("score"), "key").limit(clamp(k, 1, 50))


def reranked(hits: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Hits by a reranker's scores(key, rerank_score), missing ones 0; without scores as they were."""
    if scores is None:
        return hits.withColumn("rerank_score", F.col("score"))
    return hits.join(scores, "key", "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0))).orderBy(F.desc("rerank_score"), "key")


def grep(files: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False, limit: int = 500) -> DataFrame:
    """Lines of `files(repo, path, content)` that match: repo, path, line number, text cut at 240 characters."""
    line = F.posexplode(F.split("content", "\n", -1))
    rows = files.select("repo", "path", line.alias("n", "text"))
    if regex:
        hit = F.col("text").rlike(("(?i)" if ignore_case else "") + pattern)
    else:
        hit = F.contains(F.lower("text"), F.lit(pattern.lower())) if ignore_case else F.contains(F.col("text"), F.lit(pattern))
    return rows.where(hit).select("repo", "path", (F.col("n") + 1).alias("line"), F.substring("text", 1, 240).alias("text")).orderBy("repo", "path", "line").limit(clamp(limit, 1, 500))
