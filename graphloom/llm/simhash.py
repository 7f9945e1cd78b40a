"""SimHash near-duplicates found through anchor points of a covering code.

Every fingerprint of b = 23 * blocks bits lies within the covering radius R = 3 (per block) of
a codeword of the perfect binary Golay code; that codeword is its home anchor. If two
fingerprints differ in at most t bits, the second lies within R + t of the first one's home.
So each fingerprint is filed once as a *home* and replicated as a *probe* to all anchors
within R + t (71 of 4096 for t = 3), and homes are compared with probes anchor by anchor.
No pair is missed: the code covers the whole space. With two blocks the radii add per block
and the anchors number 2**24; that code is taken once the fingerprints outgrow one block.

Results are links to a representative, never all pairs of a group; hot anchors are split
into a grid of (home part, probe part) cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import connected_components, documents, materialize

BITS = 23
RADIUS = 3
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, reciprocal form, degree 11
ONE_BLOCK_MAX = 8_000_000  # distinct fingerprints above which two blocks are cheaper
CELL = 50_000  # homes of one anchor in one cell


def _syndromes(values):
    """Remainders of 23-bit words modulo the Golay generator polynomial, vectorised."""
    import numpy as np

    r = np.asarray(values, np.int64).copy()
    for bit in range(BITS - 1, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


def golay_offsets(max_weight: int):
    """Error patterns of weight <= max_weight by syndrome: (patterns sorted by syndrome, weights, starts)."""
    import numpy as np

    patterns = np.array([sum(c) for w in range(max_weight + 1) for c in combinations([1 << i for i in range(BITS)], w)], np.int64)
    weights = np.bitwise_count(patterns)
    syndromes = _syndromes(patterns)
    order = np.lexsort((patterns, weights, syndromes))
    starts = np.searchsorted(syndromes[order], np.arange(2049))
    return patterns[order], weights[order].astype(np.int64), starts


def word_fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the ASCII-lower-cased words' shingles (repeats count; no words: 0)."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    parts = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[b" ".join(words)]]
    count = len(parts[-1])
    ones = np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*parts)) if len(parts) > 1 else parts[0], repeat(42))
    for start in range(0, count, 1 << 16):
        n = min(1 << 16, count - start)
        h = np.fromiter(hashes, np.uint64, n)
        ones += np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """All columns of `docs` but its text, and `name` (the 64 bits as a signed long). Null text: as empty."""
    kept = [c for c in docs.columns if c != text]

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            at = b.schema.get_field_index("__text")
            fps = np.array([word_fingerprint(x.as_py(), shingle) for x in b.column(at)], np.uint64).view(np.int64)
            rest = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), pa.array(fps)], [*(b.schema.names[i] for i in rest), "__fp"])

    schema = docs.select(*kept).schema.add("__fp", "long")
    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema).withColumnRenamed("__fp", name)


def _replicas(threshold: int, blocks: int, split: dict[int, int]):
    """Arrow mapper: fp -> rows (cell, homes, probes) that hold packed fingerprints."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        patterns, weights, starts = golay_offsets(RADIUS + threshold)

        def anchors(fp):
            """Owner index and anchor of every replica, and each fingerprint's home anchor."""
            owner, code, cost = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)
            home = np.zeros(len(fp), np.int64)
            for k in range(blocks):
                word = (fp >> np.uint64(BITS * k)).astype(np.int64) & ((1 << BITS) - 1)
                syndrome = _syndromes(word)
                home = home << 12 | (word ^ patterns[starts[syndrome]]) >> 11
                mine = syndrome[owner]
                size = starts[mine + 1] - starts[mine]
                at = np.repeat(starts[mine], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                owner, code, cost = np.repeat(owner, size), np.repeat(code, size), np.repeat(cost, size)
                cost = cost + np.maximum(0, weights[at] - RADIUS)
                code = code << 12 | (word[owner] ^ patterns[at]) >> 11
                keep = cost <= threshold
                owner, code, cost = owner[keep], code[keep], cost[keep]
            return owner, code, home

        for b in batches:
            fp = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            for lo in range(0, len(fp), 20_000):
                part = fp[lo : lo + 20_000]
                owner, code, home = anchors(part)
                cells: dict[tuple, list] = {}
                for values, keys, role in ((part, home, 0), (part[owner], code, 1)):
                    order = np.argsort(keys, kind="stable")
                    keys, values = keys[order], values[order]
                    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
                    for key, group in zip(keys[cuts], np.split(values, cuts[1:])) if len(keys) else ():
                        n = split.get(int(key), 1)
                        part_of = (group * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % n
                        for i in range(n):
                            own = (group[part_of == i] if n > 1 else group).tobytes()
                            for j in range(n):
                                cell = (int(key), i, j) if role == 0 else (int(key), j, i)
                                cells.setdefault(cell, [b"", b""])[role] += own
                rows = list(cells.items())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([k[i] for k, _ in rows], pa.int64()) for i in range(3)), *(pa.array([v[i] for _, v in rows], pa.binary()) for i in range(2))],
                    ["anchor", "home_part", "probe_part", "homes", "probes"],
                )

    return run


def _compare(threshold: int):
    """Arrow group function: the links of one cell as a forest (a, b = representative)."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        joined = [b"".join(x for x in table.column(c).to_pylist() if x) for c in ("homes", "probes")]
        homes, probes = (np.unique(np.frombuffer(x, np.uint64)) for x in joined)
        nodes = np.unique(np.concatenate([homes, probes]))
        label = np.arange(len(nodes))
        at_home, at_probe = np.searchsorted(nodes, homes), np.searchsorted(nodes, probes)
        step = max(1, 2_000_000 // max(1, len(probes)))
        for lo in range(0, len(homes), step):
            near = np.bitwise_count(homes[lo : lo + step, None] ^ probes[None, :]) <= threshold
            i, j = np.nonzero(near)
            x, y = label[at_home[lo + i]], label[at_probe[j]]
            pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)])[:, x != y], axis=1)
            if not pairs.shape[1]:
                continue
            root = label
            for u, v in pairs.T.tolist():  # few: only links between labels that differ so far
                while root[u] != u:
                    u = root[u]
                while root[v] != v:
                    v = root[v]
                root[max(u, v)] = min(u, v)
            while not np.array_equal(root, root[root]):
                root = root[root]
            label = root
        linked = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table({"a": nodes[linked].view(np.int64), "b": nodes[label[linked]].view(np.int64)})

    return run


def links(distinct_fps: DataFrame, threshold: int = 3, blocks: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect all that differ in <= threshold bits."""
    fps = distinct_fps.select("fp")
    n = fps.count()
    blocks = blocks or (1 if n <= ONE_BLOCK_MAX else 2)

    def homes(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        patterns, _, starts = golay_offsets(RADIUS)
        for b in batches:
            fp = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            home = np.zeros(len(fp), np.int64)
            for k in range(blocks):
                word = (fp >> np.uint64(BITS * k)).astype(np.int64) & ((1 << BITS) - 1)
                home = home << 12 | (word ^ patterns[starts[_syndromes(word)]]) >> 11
            yield pa.RecordBatch.from_arrays([pa.array(home)], ["anchor"])

    # at most n / CELL rows: only anchors that need a split
    hot = fps.mapInArrow(homes, "anchor long").groupBy("anchor").count().where(F.col("count") > CELL).collect()
    split = {r["anchor"]: -(-r["count"] // CELL) for r in hot}
    cells = fps.mapInArrow(_replicas(threshold, blocks, split), "anchor long, home_part long, probe_part long, homes binary, probes binary")
    return cells.groupBy("anchor", "home_part", "probe_part").applyInArrow(_compare(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = 3, shingle: int = 3, blocks: int | None = None) -> DataFrame:
    """One row per document of `docs(doc_id, text)`: doc_id, fp, label, component_id, keep_id.

    label names the group of linked documents; component_id is its smallest doc_id. Null and
    blank texts have fingerprint zero and link like any other. Rows without doc_id take part;
    component_id is null if no row of the group has an id. Repeated rows stay repeated; other
    columns are ignored. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs.select("doc_id", "text"), shingle=shingle), "simhash-fp")
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    parts = materialize(connected_components(links(least, threshold, blocks), "simhash-cc"), "simhash-labels")
    labelled = least.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    groups = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    table = materialize(labelled.join(groups, "label").select("fp", "label", "component_id"), "simhash-groups")
    return prints.join(table, "fp", "left").select("doc_id", "fp", "label", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of documents."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
