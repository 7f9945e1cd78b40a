"""Toxic spans by a linear-chain conditional random field (CRF), and document scores from its marginals.

Labels exist for documents only. Token labels come from them: features (a word, its prefixes)
that occur in toxic documents far more often than chance allows (G-test) mark the toxic tokens
of toxic documents; all other tokens are clean. A two-state CRF is trained on windows of these
tokens, then forward-backward over each whole text gives the tokens' marginals. A logistic
model of the sum, maximum and density of the telling tokens' marginals gives the document's score;
spans are the runs of tokens, telling or not, whose marginals are one half or more.

The model is fitted on at most SAMPLE rows of each label (CHARS characters in all), drawn by a
hash of doc_id; every row is scored. Tokens without a weighted feature all have one emission,
so a run of k of them is one matrix power and only the other tokens cost time. Within a run
marginals fall away from its ends, so they are evaluated from a toxic end inwards while they last.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import crc_bucket, documents, free_names, map_texts, packed, unpacked

SAMPLE = 3000
CHARS = 40_000_000
FEATURES = 50_000
SIDE = 8  # words on either side of a toxic token in a training window
WINDOWS = 6  # training windows of one sampled text
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    return ["w" + word, *(word[:k] for k in (4, 5, 6, 7) if len(word) >= k)]


def _g_test(pos: int, neg: int, n_pos: int, n_neg: int) -> float:
    """G statistic of an association with toxic documents; 0 if there is none or a negative one."""
    if pos * n_neg <= neg * n_pos:
        return 0.0
    share, g = (pos + neg) / (n_pos + n_neg), 0.0
    for x, n in ((pos, n_pos), (neg, n_neg)):
        for seen, expected in ((x, n * share), (n - x, n * (1 - share))):
            if seen and expected:
                g += 2 * seen * math.log(seen / expected)
    return g


def _forward_backward(emit, trans):
    """Log-likelihood and token marginals of padded windows: emit (windows, length) is the score of state 1 over 0."""
    import numpy as np

    n, length = emit.shape
    potentials = np.stack([np.zeros_like(emit), emit], 2)
    alpha = np.empty((n, length, 2))
    alpha[:, 0] = potentials[:, 0]
    for t in range(1, length):
        alpha[:, t] = np.logaddexp(alpha[:, t - 1, :1] + trans[0], alpha[:, t - 1, 1:] + trans[1]) + potentials[:, t]
    beta = np.zeros((n, length, 2))
    for t in range(length - 2, -1, -1):
        onward = beta[:, t + 1] + potentials[:, t + 1]
        beta[:, t] = np.logaddexp(trans[:, 0] + onward[:, :1], trans[:, 1] + onward[:, 1:])
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    node = np.exp(alpha + beta - z[:, None, None])
    onward = (beta + potentials)[:, 1:]
    pair = np.exp(alpha[:, :-1, :, None] + trans[None, None] + onward[:, :, None, :] - z[:, None, None, None])
    return z, node[..., 1], pair.sum((0, 1))


def train(rows: list[tuple[str, int]], weights: tuple[float, float] = (1.0, 1.0), steps: int = 80) -> dict:
    """CRF and document model from (text, toxic 0/1) rows; weights: of a clean and of a toxic row.

    Without rows of both labels, or without telling features, the model gives every text the share of toxic rows, below one half.
    """
    import numpy as np

    words = [[m.lower() for m in _WORD.findall(t or "")] for t, _ in rows]
    labels = [y for _, y in rows]
    n_pos, n_neg = sum(labels), len(labels) - sum(labels)
    # a model that learnt nothing must not reject everything
    prior = min(0.49, (n_pos * weights[1] + 0.5) / (n_pos * weights[1] + n_neg * weights[0] + 1))
    model = {"bias": -20.0, "trans": [[0.0, 0.0], [0.0, 0.0]], "weights": {}, "doc": [math.log(prior / (1 - prior)), 0.0, 0.0, 0.0]}
    if not n_pos or not n_neg:
        return model
    pos: Counter = Counter()
    for ws, y in zip(words, labels):
        if y:
            pos.update({f for w in set(ws) for f in features_of(w)})
    least = 4
    pos = Counter({f: c for f, c in pos.items() if c >= least})
    neg: Counter = Counter()
    for ws, y in zip(words, labels):
        if not y:
            neg.update({f for w in set(ws) for f in features_of(w)} & pos.keys())
    # few features are telling, so most tokens of a text are neutral and cost nothing
    g = {f: x for f, c in pos.items() if c * (n_neg + 1) > 4 * (neg[f] + 0.5) * n_pos and (x := _g_test(c, neg[f], n_pos, n_neg)) > 15}
    kept = sorted(g, key=lambda f: (-g[f], f))[:FEATURES]
    index = {f: i for i, f in enumerate(kept)}
    seeds = {f for f in kept if g[f] > 28 and pos[f] * (n_neg + 1) > 8 * (neg[f] + 0.5) * n_pos}
    if not seeds:
        return model

    windows, tags = [], []
    for k, (ws, y) in enumerate(zip(words, labels)):
        marked = [any(f in seeds for f in features_of(w)) for w in ws]
        toxic = [i for i, m in enumerate(marked) if m]
        around = toxic[:WINDOWS] if toxic else [(k * 7919) % len(ws)] if ws else []
        for i in around:
            lo = max(0, i - SIDE)
            windows.append([[index[f] for f in features_of(w) if f in index] for w in ws[lo : lo + 2 * SIDE]])
            tags.append([int(y and m) for m in marked[lo : lo + 2 * SIDE]])
    # equal lengths form one batch
    batches = []
    for length in sorted({len(w) for w in windows}):
        mine = [i for i, w in enumerate(windows) if len(w) == length]
        at = [(r, t, f) for r, i in enumerate(mine) for t, fs in enumerate(windows[i]) for f in fs]
        r, t, f = (np.array(x, np.int64) for x in zip(*at)) if at else (np.zeros(0, np.int64),) * 3
        batches.append((r * length + t, f, np.array([tags[i] for i in mine]), length))
    w, bias, trans = np.zeros(len(index)), -3.0, np.zeros((2, 2))
    m1, m2 = np.zeros(len(w) + 5), np.zeros(len(w) + 5)
    for step in range(1, steps + 1):  # Adam on the penalised likelihood
        gw, gb, gt = -0.02 * w, 0.0, -0.02 * trans
        for cell, f, tag, length in batches:
            emit = bias + np.bincount(cell, w[f], minlength=tag.size).reshape(tag.shape)
            _, p1, pair = _forward_backward(emit, trans)
            miss = (tag - p1).ravel()
            gw = gw + np.bincount(f, miss[cell], minlength=len(w))
            gb += miss.sum()
            seen = np.zeros((2, 2))
            np.add.at(seen, (tag[:, :-1].ravel(), tag[:, 1:].ravel()), 1)
            gt = gt + seen - pair
        grad = np.concatenate([gw, [gb], gt.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        w, bias, trans = w + move[: len(w)], bias + move[len(w)], trans + move[len(w) + 1 :].reshape(2, 2)
    model |= {"bias": float(bias), "trans": trans.tolist(), "weights": {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 0.05}}

    tag_doc = tagger(model)
    x = np.array([[1.0, *tag_doc(t)[0]] for t, _ in rows])
    y = np.array(labels, float)
    c = np.where(y > 0, weights[1], weights[0])
    c = c / c.mean()
    theta = np.array(model["doc"])
    for _ in range(50):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-x @ theta))
        hessian = (x * (c * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(4)
        theta = theta + np.clip(np.linalg.solve(hessian, x.T @ (c * (y - p)) - 0.5 * theta), -2, 2)
    model["doc"] = theta.tolist()
    return model


def tagger(model: dict):
    """Function of one text: ((log of 1 + sum, maximum, density of marginals), [(start, end, marginal)] of toxic spans)."""
    import numpy as np

    weights, bias = model["weights"], model["bias"]
    trans = np.exp(np.array(model["trans"]))

    class Emissions(dict):
        def __missing__(self, word: str) -> float:
            score = sum(weights.get(f, 0.0) for f in features_of(word.lower()))
            if len(self) > 300_000:
                self.clear()
            self[word] = score
            return score

    emissions = Emissions()
    neutral = trans * np.array([1.0, math.exp(bias)])  # one step onto a neutral token
    values, left = np.linalg.eig(neutral)
    right = np.linalg.inv(left)
    top = values.real.max()

    def run_of(k: int):
        """k neutral steps, scaled."""
        return (left * (values / top) ** k @ right).real if k else np.eye(2)

    powers = [run_of(k) for k in range(64)]

    def inner(state, onward, gap: int, towards: int, taken: int = 0) -> int:
        """How many tokens of a neutral run of `gap` are toxic, counted from its left (1) or right (-1) end; `state` has seen `taken` of them."""
        for k in range(1, gap + 1):
            t = k if towards > 0 else gap + 1 - k
            p = (state @ run_of(t - taken)) * (run_of(gap - t) @ onward)
            if p[1] < p[0]:
                return k - 1
        return gap

    def tag(text: str | None):
        text = text or ""
        words = _WORD.findall(text)
        n = len(words)
        scores = np.fromiter(map(emissions.__getitem__, words), np.float64, n)
        at = np.flatnonzero(scores).tolist()
        if not at:
            return (0.0, 0.0, 0.0), []
        onto = [trans * np.array([1.0, math.exp(min(bias + scores[i], 500.0))]) for i in at]
        # forward: distribution after each weighted token; a text starts as after a clean state's flat prior
        ahead, state, before = [], None, -1
        for i, m in zip(at, onto):
            gap = i - before - 1
            if state is None:
                flat = np.array([1.0, math.exp(bias)])
                state = flat @ (powers[gap - 1] if gap <= 64 else run_of(gap - 1)) @ m if gap else m[0] / trans[0]
            else:
                state = state @ (powers[gap] if gap < 64 else run_of(gap)) @ m
            state = np.abs(state) / np.abs(state).sum()
            ahead.append(state)
            before = i
        after, p1 = np.ones(2), [0.0] * len(at)
        behind = [after] * len(at)
        nxt = n
        for j in range(len(at) - 1, -1, -1):
            gap = nxt - at[j] - 1
            after = (powers[gap] if gap < 64 else run_of(gap)) @ (onto[j + 1] @ after if j + 1 < len(at) else after)
            after = np.abs(after) / np.abs(after).sum()
            behind[j] = after
            both = ahead[j] * after
            p1[j] = float(both[1] / both.sum())
            nxt = at[j]
        total = sum(p1)
        toxic = {i: p for i, p in zip(at, p1) if p >= 0.5}
        spans = []
        if toxic:
            for j, (i, p) in enumerate(zip(at, p1)):
                if p < 0.5:
                    continue
                end = at[j + 1] if j + 1 < len(at) else n
                onward = onto[j + 1] @ behind[j + 1] if j + 1 < len(at) else np.ones(2)
                right = inner(ahead[j], onward, end - i - 1, 1)
                start = at[j - 1] if j else -1
                opening = (ahead[j - 1], 0) if j else (np.array([1.0, math.exp(bias)]), 1)
                left = inner(opening[0], onto[j] @ behind[j], i - start - 1, -1, opening[1])
                for k in (*range(i - left, i), *range(i + 1, i + right + 1)):
                    toxic.setdefault(k, 0.5)
            for i, m in enumerate(_WORD.finditer(text)):
                if i in toxic:
                    if spans and i - 1 in toxic:
                        spans[-1] = (spans[-1][0], m.end(), max(spans[-1][2], toxic[i]))
                    else:
                        spans.append((m.start(), m.end(), toxic[i]))
        return (math.log1p(total), max(p1), total / n), spans

    return tag


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = CHARS) -> dict:
    """Model of labels(doc_id, toxic) over docs(doc_id, text), from rows outside the held-out fifth.

    Null labels, labels of unknown documents and held-out rows are not used; of repeated labels
    the larger counts.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(crc_bucket(F.col("doc_id"), 5) != 0)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, sample / max(1, counts.get(1, 0)))).otherwise(min(1.0, sample / max(1, counts.get(0, 0))))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # about 2 * sample rows, whatever the input's size
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"])
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > chars:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("chars"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * chars / size))
    found = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows.where("text is not null").collect())
    weight = tuple(max(1, counts.get(y, 0)) / max(1, min(sample, counts.get(y, 0))) for y in (0, 1))
    return train([(text, y) for _, text, y in found], weight)


def scorer(model: dict):
    """Function of one text: (score in [0, 1], toxic spans as (start, end, marginal))."""
    tag, (b, *theta) = tagger(model), model["doc"]

    def score(text: str | None):
        values, spans = tag(text)
        z = b + sum(x * t for x, t in zip(values, theta))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))), spans

    return score


def score_documents(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, toxicity (0 to 1) and toxic_spans array<struct<start,end,marginal>> of every row of `docs`.

    Offsets are code points of the text as given, end exclusive; marginal is the largest of a
    span's telling tokens. Null and empty texts score as texts without any telling word; repeated
    rows are kept; an empty table gives no rows. Where a kept column bears an added column's name,
    the added one gets an underscore.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def make():
        score = scorer(sent.value)

        def both(text):
            p, spans = score(text)
            return p, [{"start": s, "end": e, "marginal": m} for s, e, m in spans]

        return both

    names = free_names(docs.select(*keep), "toxicity", "toxic_spans")
    return map_texts(docs, make, f"`{names[0]}` double, `{names[1]}` array<struct<start:int,end:int,marginal:double>>", keep=keep)


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` that a model fitted on their labels scores under `least`; all columns as they are, whatever their names."""
    rows = score_documents(packed(docs), fit(docs, labels), keep=("doc_id", "text", "others"))
    return unpacked(rows.where(F.col("toxicity") < least), docs)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the spans of every row of documents."""
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score_documents(docs, model)
    spans = F.concat_ws(",", F.transform("toxic_spans", lambda x: F.concat_ws(":", x["start"], x["end"])))
    return found.select(
        "doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), spans.alias("toxic_spans"),
    )
