"""Bigram language model with deleted interpolation.

P(w | v) = l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1), for every history v. The weights l
depend on the frequency bucket of the history; they are learned by expectation-maximisation on
held-out counts, each token of the training text held out in turn (its own occurrence is deleted
from every count). Every document contributes to the counts, every history has its own, and every
token of every document is scored with exact counts.

How it runs. (1) The text is read once and becomes blocks of documents: the block's distinct
64-bit word keys and each token's place among them. All later steps read these blocks. (2) Word
counts, combined on the map side; the counts of the CLASSES most frequent words are broadcast.
(3) Pairs of the HEAD most frequent words, which are all pairs that can be frequent: at most
HEAD**2 counts. (4) Every other token goes, packed by block, to the task that owns it: the task of
the rare word, of the rare history before a frequent word, or of the pair of frequent words. There
c(v w) and the rare word's or history's own count are local; a rare history before a rare word
has its count joined. The task writes each token's three counts, and the held-out histogram from
which the weights are learned. (5) With the weights, the counts become sums per document, which
meet by block. No task owns more than about 1/HEAD of the tokens above an even share.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import crc_bucket, discard, documents, materialize

CLASSES = 65_000  # words whose counts are broadcast; their ranks fit into 16 bits
HEAD = 512
TOKENS_A_TASK = 1_000_000
BLOCK_TOKENS = 600_000
BLOCK_DOCS = 60_000  # a place in a block fits into 16 bits
END = 0  # the end token's key
_SCALE = 2  # histogram bins of an octave


def _key_of():
    """Word -> 64-bit key, remembered per task."""
    import xxhash

    class Keys(dict):
        def __missing__(self, word: bytes) -> int:
            key = xxhash.xxh64_intdigest(word, 7) or 1
            if len(self) > 300_000:
                self.clear()
            self[word] = key
            return key

    return Keys()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _pack(value) -> bytes:
    import pickle

    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, 5))


def _unpack(data: bytes):
    import pickle

    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _planes(values) -> tuple[str, bytes]:
    """An array of numbers, byte plane by byte plane: what is mostly small compresses well."""
    import numpy as np

    return values.dtype.str, np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(planes: tuple[str, bytes]):
    import numpy as np

    kind = np.dtype(planes[0])
    return np.ascontiguousarray(np.frombuffer(planes[1], np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _tokenise(batches):
    """Arrow mapper: (doc_id, text, train) -> blocks (block, ids, tokens).

    tokens packs the distinct keys, each token's place among them (a document's words, then
    the end), the documents' token counts and the bits of `train`.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    known = _key_of()
    part = TaskContext.get().partitionId()
    block, ids, trains, held, size = 0, [], [], [], 0

    def flush():
        keys, place, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        # the end first, then by count, so that places are small numbers
        order = np.r_[0, 1 + np.argsort(-n[1:], kind="stable")]
        at = np.empty(len(keys), np.uint32)
        at[order] = np.arange(len(keys), dtype=np.uint32)
        data = _pack((keys[order], _planes(at[place]), np.array([len(x) for x in held], np.int64), np.packbits(np.array(trains, bool))))
        return pa.RecordBatch.from_arrays([pa.array([part << 24 | block]), pa.array([ids], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["block", "ids", "tokens"])

    for b in batches:
        for doc_id, text, train in zip(*(b.column(i) for i in range(3))):
            words = words_of(text.as_py())
            keys = np.zeros(len(words) + 1, np.uint64)
            keys[:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            ids.append(doc_id.as_py())
            trains.append(train.as_py())
            held.append(keys)
            size += len(keys)
            if size > BLOCK_TOKENS or len(held) >= BLOCK_DOCS:
                yield flush()
                block, ids, trains, held, size = block + 1, [], [], [], 0
    if held:
        yield flush()


def _learnt(length, train):
    """Whether each token is of a training document."""
    import numpy as np

    return np.repeat(np.unpackbits(train)[: len(length)].astype(bool), length)


def word_counts(blocks: DataFrame) -> DataFrame:
    """(w, c): count of each token of the training rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, times, size = [], [], 0

        def flush():
            keys, at = np.unique(np.concatenate(names), return_inverse=True)
            n = np.bincount(at, np.concatenate(times), len(keys)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["w", "c"])

        for b in batches:
            for data in b.column(0):
                keys, place, length, train = _unpack(data.as_py())
                place = _from_planes(place)
                n = np.bincount(place[_learnt(length, train)], minlength=len(keys))
                names.append(keys[n > 0])
                times.append(n[n > 0])
                size += len(names[-1])
                if size > 1_000_000:
                    yield flush()
                    names, times, size = [], [], 0
        if names:
            yield flush()

    return blocks.select("tokens").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The frequent words, by plain arrays: keys in order, their ranks (0: the most frequent), counts by rank."""

    def __init__(self, keys, ranks, counts, total: int, types: int):
        self.keys, self.ranks, self.counts, self.total, self.types = keys, ranks, counts, total, types
        self.size, self.head = len(counts), min(HEAD, len(counts))

    def rank(self, keys):
        """Rank of each key, `size` for other words."""
        import numpy as np

        if not self.size:
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), self.size - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], self.size)


def _frequent(counts: DataFrame, n: int) -> tuple:
    """Arrays of a Vocabulary; its words are at most n rows."""
    import numpy as np

    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    rows = counts.orderBy(F.col("c").desc(), "w").limit(n).collect()
    keys = np.array([r["w"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], order.astype(np.int64), np.array([r["c"] for r in rows], np.int64), total, types


def _buckets(classes):
    import numpy as np

    return np.floor(np.log2(np.maximum(classes, 1))).astype(np.int64)


def _bins(cv, c2, c1, total):
    """Code of held-out tokens: bucket of the history, bin of the bigram estimate, bin of the word estimate."""
    import numpy as np

    with np.errstate(divide="ignore", invalid="ignore"):
        p2 = (c2 - 1) / np.maximum(cv - 1, 1)
        p1 = (c1 - 1) / max(total - 1, 1)
        i2 = np.where(p2 > 0, 1 + np.minimum(127, np.round(-np.log2(p2) * _SCALE)), 0).astype(np.int64)
        i1 = np.where(p1 > 0, 1 + np.minimum(127, np.round(-np.log2(p1) * _SCALE)), 0).astype(np.int64)
    return _buckets(cv) << 16 | i2 << 8 | i1


def learn_weights(cells: list[tuple[int, int]], types: int, rounds: int = 60):
    """Mixture weights (64 buckets x 3: bigram, word, uniform) from a histogram of held-out tokens."""
    import numpy as np

    out = np.tile([0.3, 0.65, 0.05], (64, 1))
    if not cells:
        return out
    code, count = (np.array(x, np.int64) for x in zip(*cells))
    estimate = lambda i: np.where(i > 0, 2.0 ** (-(i - 1) / _SCALE), 0.0)
    p = np.stack([estimate(code >> 8 & 255), estimate(code & 255), np.full(len(code), 1 / (types + 1))], 1)
    bucket = code >> 16
    for _ in range(rounds):
        share = p * out[bucket]
        share = share / share.sum(1, keepdims=True) * count[:, None]
        total = np.stack([np.bincount(bucket, share[:, i], 64) for i in range(3)], 1) + np.array([0.01, 0.01, 0.01])
        out = total / total.sum(1, keepdims=True)
    return out


def _read(data: bytes, v: Vocabulary):
    """Of a block's tokens: key and rank of each and of its history (a text begins after an end), its document, and train."""
    import numpy as np

    keys, place, length, train = _unpack(data)
    place = _from_planes(place)
    ranks = v.rank(keys)
    word, key = ranks[place], keys[place]
    starts = np.cumsum(length) - length
    before = np.empty_like(place)
    before[1:] = place[:-1]
    before[starts] = 0  # the end token's place
    return key, word, keys[before], ranks[before], np.repeat(np.arange(len(length)), length), length, train


def _owner(keys, tasks: int):
    import numpy as np

    return ((keys ^ (keys >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(33)).astype(np.int64) % tasks


def _rare_pairs(sent, tasks: int):
    """Arrow mapper over blocks: (task, v, n): rare histories of each task's rare words (n: 0), and counts of head pairs (task -1)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        v = Vocabulary(*sent.value)
        pairs = np.zeros(HEAD * HEAD, np.int64)
        for b in batches:
            for data in b.column(0):
                key, word, past, history, _, length, train = _read(data.as_py(), v)
                head = (word < v.head) & (history < v.head) & _learnt(length, train)
                pairs += np.bincount(history[head] * HEAD + word[head], minlength=HEAD * HEAD)
                rare = (word == v.size) & (history == v.size)
                found = np.unique(np.stack([_owner(key[rare], tasks), past[rare].view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(np.zeros(found.shape[1], np.int64))], ["task", "v", "n"])
        cells = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), -1)), pa.array(cells), pa.array(pairs[cells])], ["task", "v", "n"])

    return run


def _runs(sorted_keys):
    """Distinct values of a sorted array and their counts."""
    import numpy as np

    edges = np.flatnonzero(np.r_[len(sorted_keys) > 0, sorted_keys[1:] != sorted_keys[:-1]])
    return sorted_keys[edges], np.diff(np.r_[edges, len(sorted_keys)]).astype(np.uint32)


def _messages(sent, tasks: int):
    """Arrow mapper: blocks -> rows (task, payload): what one task needs of one block's tokens beyond the head pairs.

    frequent: pairs of frequent words, as history * size + word. word: rare words with their
    histories. past: rare histories before frequent words. more: training counts of rare histories
    before rare words, whose tokens the word's task owns.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        v = Vocabulary(*sent.value)
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1)):
                key, word, past, history, doc, length, train = _read(data.as_py(), v)
                out: dict[int, dict] = {}

                def deal(which, owner, fields, order):
                    """Rows `which`, sorted by `order` and dealt by owner: {task: fields}."""
                    by = order[np.argsort(owner[order].astype(np.uint16 if tasks < 1 << 16 else np.uint32), kind="stable")]
                    cuts = np.searchsorted(owner[by], np.arange(tasks + 1))
                    full = np.flatnonzero(cuts[1:] > cuts[:-1])
                    for t in full.tolist():
                        out.setdefault(t, {})[which] = fields(by[cuts[t] : cuts[t + 1]])

                rare_w, rare_v = word == v.size, history == v.size
                at = np.flatnonzero(~rare_w & ~rare_v & ((word >= v.head) | (history >= v.head)))
                pair = history[at] * v.size + word[at]
                deal("frequent", _owner(pair.astype(np.uint64), tasks), lambda x, at=at, pair=pair: (_planes(np.diff(pair[x], prepend=0).astype(np.uint32)), doc[at[x]].astype(np.uint16)), np.argsort(pair))
                at = np.flatnonzero(rare_w)
                w = key[at]
                deal("word", _owner(w, tasks), lambda x, at=at, w=w: (*_runs(w[x]), history[at[x]].astype(np.uint16), past[at[x]][history[at[x]] == v.size], doc[at[x]].astype(np.uint16)), np.argsort(w))
                at = np.flatnonzero(rare_v & ~rare_w)
                h = past[at]
                deal("past", _owner(h, tasks), lambda x, at=at, h=h: (*_runs(h[x]), word[at[x]].astype(np.uint16), doc[at[x]].astype(np.uint16)), np.argsort(h))
                at = np.flatnonzero(rare_v & rare_w & _learnt(length, train))
                names, times = _runs(np.sort(past[at]))
                deal("more", _owner(names, tasks), lambda x, names=names, times=times: (names[x], times[x]), np.arange(len(names)))
                rows = [(t, _pack((block, train, parts))) for t, parts in sorted(out.items())]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["task", "payload"])

    return run


def _ranked(first, second, learnt):
    """Training counts of each row's `first`, and of its (first, second)."""
    import numpy as np

    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    edge = np.r_[len(a) > 0, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    both = edge | (np.r_[True, b[1:] != b[:-1]] if len(b) else edge)
    one, two = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
    for made, ids in ((one, np.cumsum(edge) - 1), (two, np.cumsum(both) - 1)):
        made[order] = np.bincount(ids, learnt[order])[ids] if len(a) else 0
    return one, two


def _looked_up(names, times, wanted):
    """Sum of `times` at the names that equal each wanted key; 0 where none does."""
    import numpy as np

    if not len(names):
        return np.zeros(len(wanted), np.int64)
    keys, at = np.unique(names, return_inverse=True)
    n = np.bincount(at, times, len(keys)).astype(np.int64)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, n[place], 0)


def _count(sent):
    """Arrow group function: one task's messages and its rare histories' counts -> (code, n, block, found).

    Rows of the held-out histogram have code and n; a row per block has found: for each token its
    document and its counts c(v w), c(w), c(v).
    """

    def run(table, rare):
        import numpy as np
        import pyarrow as pa

        v = Vocabulary(*sent.value)
        messages = [_unpack(x) for x in table.column("payload").to_pylist()]
        counts = np.append(v.counts, 0)
        found: dict[int, list] = {i: [] for i in range(len(messages))}
        bins: list[tuple] = []

        def gathered(which):
            """Messages that hold a part, their places, train flag of every token."""
            own = [(i, m[2][which]) for i, m in enumerate(messages) if which in m[2]]
            learnt = [np.unpackbits(messages[i][1])[p[-1]] for i, p in own]
            return [i for i, _ in own], [p for _, p in own], np.concatenate(learnt) if learnt else np.zeros(0, np.uint8)

        def joined(parts, k, kind):
            return np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)

        def add(places, parts, learnt, c2, c1, cv):
            seen = learnt > 0
            bins.append(np.unique(_bins(cv[seen], c2[seen], c1[seen], v.total), return_counts=True))
            small = np.uint32 if v.total < 1 << 32 else np.int64
            c2, c1, cv = c2.astype(small), c1.astype(small), cv.astype(small)
            cuts = np.cumsum([0] + [len(p[-1]) for p in parts])
            for i, p, lo, hi in zip(places, parts, cuts, cuts[1:]):
                found[i].append((p[-1], c2[lo:hi], c1[lo:hi], cv[lo:hi]))

        places, parts, learnt = gathered("frequent")
        pair = np.concatenate([np.cumsum(_from_planes(p[0]), dtype=np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
        c2, _ = _ranked(pair, np.zeros(len(pair), np.uint8), learnt)
        add(places, parts, learnt, c2, counts[pair % max(v.size, 1)], counts[pair // max(v.size, 1)])

        places, parts, learnt = gathered("word")
        w = np.concatenate([np.repeat(p[0], p[1]) for p in parts]) if parts else np.zeros(0, np.uint64)
        history = joined(parts, 2, np.uint16).astype(np.int64)
        past = history.astype(np.uint64)
        past[history == v.size] = joined(parts, 3, np.uint64)
        c1, c2 = _ranked(w, past, learnt)
        add(places, parts, learnt, c2, c1, np.where(history < v.size, counts[history], _looked_up(rare.column("v").to_numpy().astype(np.int64).view(np.uint64), rare.column("c").to_numpy(), past)))

        places, parts, learnt = gathered("past")
        h = np.concatenate([np.repeat(p[0], p[1]) for p in parts]) if parts else np.zeros(0, np.uint64)
        word = joined(parts, 2, np.uint16).astype(np.int64)
        cv, c2 = _ranked(h, word, learnt)
        extra = [m[2]["more"] for m in messages if "more" in m[2]]
        cv = cv + _looked_up(joined(extra, 0, np.uint64), joined(extra, 1, np.uint32), h)
        add(places, parts, learnt, c2, counts[word], cv)

        code, times = np.concatenate([c for c, _ in bins]), np.concatenate([n for _, n in bins])
        kept = [(messages[i][0], _pack([_planes(np.concatenate(x)) for x in zip(*parts)])) for i, parts in found.items() if parts]
        none = [None] * len(code)
        return pa.table({
            "code": pa.array([*code.tolist(), *[None] * len(kept)], pa.int64()), "n": pa.array([*times.tolist(), *[None] * len(kept)], pa.int64()),
            "block": pa.array([*none, *(b for b, _ in kept)], pa.int64()), "found": pa.array([*none, *(x for _, x in kept)], pa.binary()),
        })

    return run


def _dense(rows: DataFrame, key: str, value: str, width: int) -> dict[int, int]:
    """{key: value} of rows whose keys come from a fixed small range; packed on the executors, `width` keys a row."""

    def run(_, table):
        import pyarrow as pa

        return pa.table({"k": pa.array([table.column(key).to_numpy().astype("<i8").tobytes()], pa.binary()), "x": pa.array([table.column(value).to_numpy().astype("<i8").tobytes()], pa.binary())})

    import numpy as np

    found = rows.groupBy(F.floor(F.col(key) / width).alias("at")).applyInArrow(run, "k binary, x binary").collect()
    return {k: x for r in found for k, x in zip(np.frombuffer(r["k"], "<i8").tolist(), np.frombuffer(r["x"], "<i8").tolist())}


def _sums(block: int, known, base, score, at=None, ids=None, length=None):
    """A row (block, at, sums, ids, n_tokens) of partial sums; `at`: places of the documents, None for all."""
    import numpy as np

    return block, None if at is None else at.astype("<u2").tobytes(), np.stack([known, base, score]).astype("<f8").tobytes(), ids, None if length is None else length.astype("<i8").tobytes()


_SUMS = "block long, at binary, sums binary, ids array<long>, n_tokens binary"


def _sum_batch(rows):
    import pyarrow as pa

    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["block", "at", "sums", "ids", "n_tokens"])


def _head_sums(sent, pairs, weights):
    """Arrow mapper: blocks (block, ids, tokens) -> sums of their head pairs, with the documents' ids and token counts."""

    def run(batches):
        import numpy as np

        v = Vocabulary(*sent.value)
        n = v.head
        c, w = pairs.value.reshape(HEAD, HEAD)[:n, :n], weights.value[_buckets(v.counts[:n])]
        with np.errstate(divide="ignore"):
            p = w[:, :1] * c / np.maximum(v.counts[:n, None], 1) + w[:, 1:2] * (v.counts[None, :n] / max(v.total, 1)) + w[:, 2:] / (v.types + 1)
        score, base = np.log10(p), np.log10((v.counts[:n] + 1) / (v.total + v.types + 1))
        for b in batches:
            for block, ids, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                _, word, _, history, doc, length, _ = _read(data.as_py(), v)
                head = np.flatnonzero((word < n) & (history < n))
                d, w1, h = doc[head], word[head], history[head]
                total = [np.bincount(d, x, len(ids)) for x in (None, base[w1], score[h, w1])]
                yield _sum_batch([_sums(block, *total, None, ids, length)])

    return run


def _other_sums(sent, weights):
    """Arrow mapper: rows (block, found) -> sums of each block's other tokens, several rows of a block together."""

    def run(batches):
        import numpy as np

        v = Vocabulary(*sent.value)
        held: dict[int, list] = {}
        size = 0

        def flush():
            for block, parts in held.items():
                d = np.concatenate([p[0] for p in parts])
                at, own = np.unique(d, return_inverse=True)
                yield _sum_batch([_sums(block, *(np.bincount(own, np.concatenate([p[i] for p in parts]), len(at)) for i in (1, 2, 3)), at)])

        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1)):
                d, c2, c1, cv = (_from_planes(x).astype(np.int64) for x in _unpack(data.as_py()))
                w = weights.value[_buckets(cv)]
                p = w[:, 0] * c2 / np.maximum(cv, 1) + w[:, 1] * c1 / max(v.total, 1) + w[:, 2] / (v.types + 1)
                n = int(d.max()) + 1
                sums = [np.bincount(d, x, n) for x in (c1 > 0, np.log10((c1 + 1) / (v.total + v.types + 1)), np.log10(p))]
                at = np.flatnonzero(np.bincount(d, minlength=n))
                held.setdefault(block, []).append((at, *(x[at] for x in sums)))
                size += len(at)
                if size > 1_000_000:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return run


def _sum_block(table):
    """Arrow group function: all sums of one block of documents -> a row per document."""
    import numpy as np
    import pyarrow as pa

    rows = table.to_pylist()
    own = next(r for r in rows if r["ids"] is not None)
    total = np.zeros((3, len(own["ids"])))
    for r in rows:
        at = slice(None) if r["at"] is None else np.frombuffer(r["at"], "<u2")
        total[:, at] += np.frombuffer(r["sums"], "<f8").reshape(3, -1)
    return pa.table({
        "doc_id": pa.array(own["ids"], pa.int64()), "n_tokens": pa.array(np.frombuffer(own["n_tokens"], "<i8")),
        "n_known": pa.array(np.rint(total[0]).astype(np.int64)), "base_score": pa.array(total[1]), "score": pa.array(total[2]),
    })


def score_documents(docs: DataFrame, train) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of `docs(doc_id, text)`.

    `train`: a column over doc_id, true for the rows to learn from. Null and empty texts are an
    end token alone. Rows without doc_id and repeated rows are scored each on its own; other
    columns are ignored; an empty table gives no rows. Without training rows every token has the
    uniform estimate.
    """
    import numpy as np

    sc = docs.sparkSession.sparkContext
    blocks = materialize(docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train")).mapInArrow(_tokenise, "block long, ids array<long>, tokens binary"), "lm-tokens")
    counts = materialize(word_counts(blocks), "lm-words")
    arrays = _frequent(counts, CLASSES)
    sent = sc.broadcast(arrays)  # at most CLASSES words, as arrays
    v = Vocabulary(*arrays)
    share = docs.agg(F.avg(F.coalesce(train, F.lit(False)).cast("double"))).first()[0] or 1.0
    tasks = max(8, math.ceil(v.total / max(share, 0.01) / TOKENS_A_TASK))

    pairs = materialize(blocks.select("tokens").mapInArrow(_rare_pairs(sent, tasks), "task long, v long, n long").groupBy("task", "v").agg(F.sum("n").alias("n")), "lm-pairs")
    rare = pairs.where("task >= 0").join(counts.select(F.col("w").alias("v"), "c"), "v").select("task", "v", "c")
    messages = blocks.select("block", "tokens").mapInArrow(_messages(sent, tasks), "task long, payload binary")
    found = materialize(messages.groupBy("task").cogroup(rare.groupBy("task")).applyInArrow(_count(sent), "code long, n long, block long, found binary"), "lm-counts")

    cells = _dense(found.where("code is not null").groupBy("code").agg(F.sum("n").alias("n")), "code", "n", 1 << 16)
    matrix = np.zeros(HEAD * HEAD, np.int64)
    for cell, n in _dense(pairs.where("task < 0").select("v", "n"), "v", "n", 1 << 12).items():
        matrix[cell] = n
    history, word = np.nonzero(matrix.reshape(HEAD, HEAD))
    c = matrix.reshape(HEAD, HEAD)[history, word]
    for code, n in zip(_bins(v.counts[history], c, v.counts[word], v.total).tolist(), c.tolist()) if len(c) else ():
        cells[code] = cells.get(code, 0) + n
    discard(counts, pairs)
    weights = sc.broadcast(learn_weights(sorted(cells.items()), v.types))
    parts = blocks.mapInArrow(_head_sums(sent, sc.broadcast(matrix), weights), _SUMS)
    parts = parts.unionByName(found.where("block is not null").select("block", "found").mapInArrow(_other_sums(sent, weights), _SUMS))
    summed = parts.groupBy("block").applyInArrow(_sum_block, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return summed.select("doc_id", "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every row of documents; learns from those whose id's crc32 is not 2 modulo 7."""
    remainder = crc_bucket(F.col("doc_id"), 7)
    found = score_documents(documents(spark, sf_dir), remainder != 2)
    return found.select("doc_id", (remainder == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
