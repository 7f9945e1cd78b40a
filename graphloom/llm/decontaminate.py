"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel edit distance.

Both sides are folded to lower-case words. An item of m words may be met with up to
k = floor((1 - similarity) * m) word edits; it is split into k + 1 pieces, and if a passage is
within k edits then at least one piece stands in it unchanged. All pieces of a block of items
form one Aho-Corasick automaton that each text streams through; every piece hit names a place
where the item may stand, and Myers' algorithm verifies the surrounding window.
Items go in blocks of bounded total length, so the automaton's size is bounded; each block
scans all documents. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents, map_texts, packed, unpacked

SIMILARITY = 0.8
BLOCK_CHARS = 8_000_000  # items of one automaton; about 40 bytes of memory a character
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def edit_budget(m: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * m + 1e-9)


def pieces_of(words: list[str], budget: int) -> list[tuple[int, list[str]]]:
    """budget + 1 nearly equal pieces as (start, words)."""
    n = len(words)
    cuts = [i * n // (budget + 1) for i in range(budget + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers_search(pattern_masks: dict, m: int, text: list) -> tuple[int, int]:
    """(least edit distance of the pattern to any run of `text`, first end of such a run).

    Bit-vectors are Python integers, so a pattern may have any number of words.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for i, token in enumerate(text):
        eq = pattern_masks.get(token, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & high) - bool(mh & high)
        if score < best:
            best, end = score, i + 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return best, end


def windows(begins: list[int], m: int, budget: int, n: int) -> list[tuple[int, int]]:
    """Word ranges around where an item may begin, overlapping ones joined."""
    out: list[list[int]] = []
    for begin in begins:
        lo, hi = max(0, begin - budget), min(n, begin + m + budget)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def masks_of(words: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def make_matcher(items: list[tuple], similarity: float = SIMILARITY):
    """Function of one text: [(item key, distance, start word, end word, n item words)], the best place of each item."""
    import ahocorasick

    wanted: dict[str, list] = {}
    info = {}
    for key, text in items:
        words = words_of(text)
        if not words:
            continue
        budget = edit_budget(len(words), similarity)
        info[key] = (words, budget, masks_of(words), masks_of(words[::-1]))
        for start, piece in pieces_of(words, budget):
            wanted.setdefault(f" {' '.join(piece)} ", []).append((key, start))
    automaton = ahocorasick.Automaton()
    for piece, owners in wanted.items():
        automaton.add_word(piece, (piece.count(" ") - 1, owners))
    automaton.make_automaton()

    def match(text: str | None):
        if not wanted:
            return []
        words = words_of(text)
        # offsets of the words in the joined text, found only if a piece is hit
        joined = f" {' '.join(words)} "
        places: dict = {}
        at = None
        for end, (n, owners) in automaton.iter(joined):
            if at is None:
                import numpy as np

                at = np.cumsum([1] + [len(w) + 1 for w in words])
            last = int(at.searchsorted(end + 1))  # words that end before or at this place
            for key, start in owners:
                places.setdefault(key, set()).add(last - n - start)
        out = []
        for key, begins in places.items():
            item, budget, ahead, back = info[key]
            m, best = len(item), None
            for lo, hi in windows(sorted(begins), m, budget, len(words)):
                distance, end = myers_search(ahead, m, words[lo:hi])
                if distance <= budget and (best is None or distance < best[0]):
                    _, length = myers_search(back, m, words[lo : lo + end][::-1])
                    best = (distance, lo + end - length, lo + end)
                    if not distance:
                        break
            if best:
                out.append((key, *best, m))
        return sorted(out, key=lambda x: (x[1], str(x[0])))

    return match


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Distinct (item_id, text) of the benchmark in blocks of about BLOCK_CHARS characters, one block at a time on the driver."""
    sized = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS) or 1
    for i in range(blocks):
        mine = sized.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i) if blocks > 1 else sized
        yield [(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, distance, start_word, end_word, item_words, similarity) of each item met in each document.

    One row for an item in a document row: its best place. Null, empty and wordless texts and
    items match nothing; rows without doc_id and repeated rows are matched like others; repeated
    items count once; other columns are ignored. An item shorter than 5 words must stand
    unchanged. Empty tables give no rows.
    """
    parts = []
    for own in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(own)  # about BLOCK_CHARS characters

        def make(sent=sent):
            own = sent.value
            match = make_matcher([(k, text) for k, (_, text) in enumerate(own)], similarity)
            return lambda text: ([{"item_id": own[k][0], "distance": d, "start_word": a, "end_word": b, "item_words": m} for k, d, a, b, m in match(text)],)

        fields = "hits array<struct<item_id:bigint,distance:int,start_word:int,end_word:int,item_words:int>>"
        parts.append(map_texts(docs, make, fields).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*"))
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("similarity", 1 - F.col("distance") / F.col("item_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` in whose text no benchmark item is met; all columns as they are, whatever their names.

    Null and empty texts, rows without doc_id and repeated rows stay; an empty benchmark drops nothing.
    """
    rows = packed(docs)
    for own in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(own)

        def make(sent=sent):
            match = make_matcher(list(enumerate(text for _, text in sent.value)), similarity)
            return lambda text: (bool(match(text)),)

        rows = map_texts(rows, make, "met boolean", keep=("doc_id", "text", "others")).where("not met").drop("met")
    return unpacked(rows, docs)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item met in every row of documents, with its best place and word edit distance."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
