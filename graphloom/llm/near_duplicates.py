"""Near-duplicates: SimHash candidates through covering-code anchors, confirmed by exact Jaccard similarity.

Documents of equal five-word shingle sets form one node. Two nodes are linked if their sets have
a Jaccard similarity of 0.8 or more; groups are connected nodes.

Candidates. At similarity 0.8 about 15 % of SimHash bits differ (10 of 64), far beyond what one
64-bit fingerprint with a small radius finds. So a node has BLOCKS fingerprints of 23 bits, each
a block of its own perfect Golay code (simhash.py): it is filed at its home anchor and replicated
to all anchors within the covering radius 3 plus REACH bits (5.3 on average), block by block.
Per anchor, homes are compared with all that is filed there: sizes of a ratio of 0.8 or more, and
at most CHECK_DISTANCE of CHECK_BITS bits apart. A pair of similarity 0.8 meets in a block with
probability 0.28, in one of 16 with 0.994; one of 0.85 with 0.9995. An anchor with many homes is
split into a grid of (home part, replica part) cells of bounded size.

Confirmation. Candidate links come out as forests; their components are small. Each goes, with
one text a node, to a task that compares the sets exactly by an inverted index. A component
beyond PART_NODES nodes or PART_SHINGLES shingles is split into parts and every two parts meet in a
task of their own, so no task holds more than two parts, and no pair is missed.

Texts are shuffled only for the nodes of candidate components and for rows that may go.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm import simhash
from graphloom.llm.common import connected_components, discard, materialize, sieve, split_by_sieve

SHINGLE = 5
BLOCKS = 16
REACH = 1
CHECK_BITS = 128
CHECK_DISTANCE = 30  # three deviations above the 19.3 bits expected at similarity 0.8; chance differs in 64
PART_NODES = 1000
PART_SHINGLES = 2_500_000  # about 16 MB of text
BIN_NODES = 4000  # nodes whose records make one bin
_RATIO = 0.8


def _word_keys():
    import xxhash

    class Keys(dict):
        def __missing__(self, word: bytes) -> int:
            key = xxhash.xxh64_intdigest(word, 42)
            if len(self) > 300_000:
                self.clear()
            self[word] = key
            return key

    return Keys()


def _mix(x):
    """Finaliser of 64-bit hashes, vectorised."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, known=None):
    """Sorted 64-bit hashes of the ASCII-lower-cased words' shingles (fewer words: one shingle; none: empty)."""
    import numpy as np

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _word_keys() if known is None else known
    keys = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + keys[i : i + n])
    return np.unique(h)


def node_of(shingles) -> int:
    """The set's own 64-bit key, signed."""
    import xxhash

    h = xxhash.xxh64_intdigest(shingles.tobytes(), 1)
    return h - (1 << 64) if h >> 63 else h


def _fingerprint(shingles):
    """(BLOCKS * 23 bits as 0/1, the first CHECK_BITS as bytes) of a set; a bit is 1 if set in over half the hashes."""
    import numpy as np

    words = -(-BLOCKS * simhash.BITS // 64)
    odd = np.uint64(2) * np.arange(101, 101 + words, dtype=np.uint64) + np.uint64(1)
    ones = np.zeros(words * 64, np.int64)
    for lo in range(0, len(shingles), 255):  # counts of 255 rows fit into a byte
        h = _mix(shingles[lo : lo + 255, None] * odd[None, :] + odd[None, :])
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    bits = (ones * 2 > len(shingles)).astype(np.uint8)
    return bits[: BLOCKS * simhash.BITS], np.packbits(bits[:CHECK_BITS], bitorder="little").tobytes()


def groups_of(sets: list) -> list[int]:
    """For each set, the first set of its group; groups connect all pairs of similarity >= 0.8 (exact)."""
    import numpy as np

    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    mine = np.split(ids, np.cumsum(size)[:-1])
    kinds = int(ids.max()) + 1 if len(ids) else 0
    label = np.full(n, -1, np.int64)

    def index():
        """Postings of the sets that no group has yet."""
        left = np.repeat(label < 0, size)
        at, owner = ids[left], np.repeat(np.arange(n), size)[left]
        order = np.argsort(at, kind="stable")
        return owner[order], np.searchsorted(at[order], np.arange(kinds + 1))

    owners, starts = index()
    stale = 0
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed], found = seed, [seed]
        stale += size[seed]
        while found:
            i = found.pop()
            if stale * 2 > len(owners):
                (owners, starts), stale = index(), 0
            if not len(owners):
                break
            lo, length = starts[mine[i]], starts[mine[i] + 1] - starts[mine[i]]
            at = np.repeat(lo - (np.cumsum(length) - length), length) + np.arange(length.sum())
            shared = np.bincount(owners[at], minlength=n)
            near = np.flatnonzero((label < 0) & (shared > 0) & (9 * shared >= 4 * (size + size[i])))  # inter / union >= 4 / 5
            label[near] = seed
            stale += size[near].sum()
            found += near.tolist()
    return label.tolist()


def _tag(names: list[str]):
    """Arrow mapper: the last column, a text, gives way to the node, the set's size, the blocks' packed bits and the check bits."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known = _word_keys()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                node, size, blocks, check = [], [], [], []
                for x in part.column(part.num_columns - 1):
                    s = shingle_set(x.as_py(), known)
                    bits, first = _fingerprint(s)
                    node.append(node_of(s))
                    size.append(len(s))
                    blocks.append(np.packbits(bits, bitorder="little").tobytes())
                    check.append(first)
                made = [pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(blocks, pa.binary()), pa.array(check, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names)

    return run


def _record():
    import numpy as np

    return np.dtype([("cell", "<u4"), ("replica", "u1"), ("size", "<u4"), ("node", "<i8"), ("check", "<u8", CHECK_BITS // 64)])


def _anchors(blocks, size: int):
    """Home anchor of each of `size` nodes in each block, and (owner, block, anchor) of all replicas at other anchors."""
    import numpy as np

    bits = np.unpackbits(np.frombuffer(blocks, np.uint8).reshape(size, -1), axis=1, bitorder="little")[:, : BLOCKS * simhash.BITS]
    word = (bits.reshape(size, BLOCKS, simhash.BITS).astype(np.int64) << np.arange(simhash.BITS)).sum(2).ravel()
    patterns, weights, starts = simhash.golay_offsets(simhash.RADIUS + REACH)
    syndrome = simhash._syndromes(word)
    home = (word ^ patterns[starts[syndrome]]) >> 11
    n = starts[syndrome + 1] - starts[syndrome] - 1  # all but the home
    at = np.repeat(starts[syndrome] + 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    owner = np.repeat(np.arange(len(word)), n)
    return home.reshape(size, BLOCKS), (owner // BLOCKS, owner % BLOCKS, (word[owner] ^ patterns[at]) >> 11)


def _file(bins: int, split: dict[int, int]):
    """Arrow mapper: (node, size, blocks, check) -> rows (bin, records); a cell is block << 12 | anchor, and its grid place."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kind = _record()
        for b in batches:
            for lo in range(0, b.num_rows, BIN_NODES):
                part = b.slice(lo, BIN_NODES)
                n = part.num_rows
                node, size = part.column(0).to_numpy(), part.column(1).to_numpy()
                check = np.frombuffer(b"".join(part.column(3).to_pylist()), "<u8").reshape(n, -1)
                home, (owner, block, anchor) = _anchors(b"".join(part.column(2).to_pylist()), n)
                own = np.repeat(np.arange(n), BLOCKS)
                who = np.concatenate([own, owner])
                cell = np.concatenate([(np.tile(np.arange(BLOCKS), n) << 12) | home.ravel(), (block << 12) | anchor])
                out = np.zeros(len(who), kind)
                out["cell"], out["replica"] = cell, np.arange(len(who)) >= len(own)
                out["size"], out["node"], out["check"] = np.minimum(size[who], (1 << 32) - 1), node[who], check[who]
                place = np.zeros(len(who), np.int64)
                if split:
                    parts = np.fromiter((split.get(c, 1) for c in cell.tolist()), np.int64, len(cell))
                    again = np.flatnonzero(parts > 1)
                    # grid place (i, j): homes of part i meet everything of part j; a replica comes once a row, a home in its row as well
                    copies = np.where(out["replica"][again] == 0, 2 * parts[again] - 1, parts[again])
                    at = np.repeat(again, copies)
                    turn = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                    k, mine = parts[at], (node[who[at]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts[at]
                    other = np.where(turn < k, turn, (mine + 1 + turn - k) % k)
                    as_home = (turn < k) & (out["replica"][at] == 0)
                    i, j = np.where(as_home, mine, np.where(turn < k, turn, other)), np.where(as_home, turn, mine)
                    more = out[at]
                    more["replica"] = np.where(as_home, 0, 1)
                    keep = np.flatnonzero(parts == 1)
                    out, place = np.concatenate([out[keep], more]), np.concatenate([place[keep], 1 + i * k + j])
                mix = (out["cell"].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
                to = (mix >> np.uint64(33)).astype(np.int64) % bins
                order = np.lexsort((place, out["cell"], to))
                out, to, place = out[order], to[order], place[order]
                cuts = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (place[1:] != place[:-1])]) if len(to) else np.zeros(0, np.int64)
                ends = [*cuts[1:].tolist(), len(to)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[cuts], pa.int64()), pa.array(place[cuts], pa.int64()), pa.array([out[a:z].tobytes() for a, z in zip(cuts.tolist(), ends)], pa.binary())],
                    ["bin", "place", "records"],
                )

    return run


def _forest(home, size, check):
    """For each record of a cell, in order of size, the first record of its group; only homes are compared with all."""
    import numpy as np

    label = np.arange(len(size))
    homes = np.flatnonzero(home)
    step = max(1, 1_000_000 // len(size))
    for at in range(0, len(homes), step):
        chunk = homes[at : at + step]
        lo = np.searchsorted(size, np.ceil(size[chunk[0]] * _RATIO - 1e-9))
        hi = np.searchsorted(size, np.floor(size[chunk[-1]] / _RATIO + 1e-9), "right")
        apart = np.bitwise_count(check[chunk, None, :] ^ check[None, lo:hi, :]).sum(2, dtype=np.uint8)
        i, j = np.nonzero(apart <= CHECK_DISTANCE)
        i, j = chunk[i], lo + j
        x, y = label[i], label[j]
        fit = (x != y) & (np.minimum(size[i], size[j]) * 5 >= np.maximum(size[i], size[j]) * 4)
        if not fit.any():
            continue
        pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)])[:, fit], axis=1)
        for u, v in pairs.T.tolist():  # few: only links between labels that differ so far
            while label[u] != u:
                u = label[u]
            while label[v] != v:
                v = label[v]
            label[max(u, v)] = min(u, v)
        while not np.array_equal(label, label[label]):
            label = label[label]
    return label


def _meet(table):
    """Arrow group function: candidate links (a, b) of one bin: each node of a group of linked cells to the group's least node."""
    import numpy as np
    import pyarrow as pa

    kind = _record()
    blobs = table.column("records").to_pylist()
    place = np.repeat(table.column("place").to_numpy(), [len(x) // kind.itemsize for x in blobs])
    records = np.frombuffer(b"".join(blobs), kind)
    order = np.lexsort((records["size"], place, records["cell"]))
    records, place = records[order], place[order]
    cell, node, size, home = records["cell"], records["node"], records["size"].astype(np.int64), records["replica"] == 0
    check = np.ascontiguousarray(records["check"])
    edges = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (place[1:] != place[:-1]), True]).tolist()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(edges, edges[1:]):
        if hi - lo > 1 and home[lo:hi].any():
            label = _forest(home[lo:hi], size[lo:hi], check[lo:hi])
            linked = np.flatnonzero(label != np.arange(hi - lo))
            if len(linked):
                a.append(node[lo + linked])
                b.append(node[lo + label[linked]])
    nodes, ends = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    root = list(range(len(nodes)))
    for u, v in np.unique(ends.reshape(2, -1), axis=1).T.tolist():
        while root[u] != u:
            root[u] = u = root[root[u]]
        while root[v] != v:
            root[v] = v = root[root[v]]
        root[max(u, v)] = min(u, v)
    label = np.array(root, np.int64)
    while not np.array_equal(label, label[label]):
        label = label[label]
    linked = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": nodes[linked], "b": nodes[label[linked]]})


def candidate_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that connect all nodes of `nodes(node, size, blocks, check)` that meet at an anchor and look alike."""
    own = nodes.where("size > 0").select("node", "size", "blocks", "check")

    def homes(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                home, _ = _anchors(b"".join(b.column(0).to_pylist()), b.num_rows)
                cell, n = np.unique((np.tile(np.arange(BLOCKS), b.num_rows) << 12) | home.ravel(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    # BLOCKS * 4096 cells
    cells = own.select("blocks").mapInArrow(homes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    split = {r["cell"]: -(-r["n"] // simhash.CELL) for r in cells if r["n"] > simhash.CELL}
    bins = max(1, -(-sum(r["n"] for r in cells) // BLOCKS // BIN_NODES))
    filed = own.mapInArrow(_file(bins, split), "bin long, place long, records binary")
    return filed.groupBy("bin").applyInArrow(_meet, "a long, b long")


def _confirm(table):
    """Arrow group function: (node, group) of one component, or of two parts of one, for nodes not alone; exact."""
    import numpy as np
    import pyarrow as pa

    known = _word_keys()
    nodes = table.column("node").to_numpy()
    group = np.array(groups_of([shingle_set(x.as_py(), known) for x in table.column("text")]), np.int64)
    linked = np.flatnonzero(group != np.arange(len(group)))
    return pa.table({"node": pa.array(nodes[linked], pa.int64()), "group": pa.array(nodes[group[linked]], pa.int64())})


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs(doc_id, text, ...)` that stay when each group of near-duplicates keeps its smallest doc_id.

    Null and blank texts form one group. A group without any id keeps one row; of repeated rows of
    the kept id one stays. An empty table gives no rows; other columns are kept, whatever their names.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("row", F.monotonically_increasing_id())
    text, doc_id = f"c{names.index('text')}", f"c{names.index('doc_id')}"
    schema = StructType([*plain.schema, *StructType.fromDDL("node long, size long, blocks binary, check binary")])
    tagged = materialize(plain.select(*plain.columns, F.col(text).alias("sent")).mapInArrow(_tag(schema.names), schema), "near-rows")
    rank = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col("row"))
    firsts = (F.min(rank).alias("best"), F.count(F.lit(1)).alias("rows"), F.first("size").alias("size"), F.first("blocks").alias("blocks"), F.first("check").alias("check"))
    nodes = materialize(tagged.groupBy("node").agg(*firsts), "near-nodes")
    parts = connected_components(candidate_links(nodes), "near-cc")

    # components of candidates, dealt to tasks; only the last join moves texts
    member = materialize(nodes.select("node", "size", F.col("best.row").alias("row")).join(parts, "node"), "near-members")
    sizes = member.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    sizes = sizes.select("label", F.greatest(F.ceil(F.col("n") / PART_NODES), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("int").alias("k"))
    dealt = member.join(sizes, "label").withColumn("p", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    others = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda q: q != F.col("p")))
    dealt = dealt.withColumn("q", F.explode(others)).select("label", "node", "row", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    picked, _ = split_by_sieve(tagged.select("row", F.col(text).alias("text")), "row", sieve(member.select("row")))
    dealt = picked.join(dealt, "row").select("label", "p", "q", "node", "text")
    links = materialize(dealt.groupBy("label", "p", "q").applyInArrow(_confirm, "node long, group long"), "near-links")
    groups = connected_components(links.select(F.col("node").alias("a"), F.col("group").alias("b")), "near-groups")

    # a node goes unless it is the best of its group; of an own node's rows all but the best go
    ranked = nodes.join(groups, "node", "left").select("node", "best", "rows", F.coalesce("label", "node").alias("group"))
    best = ranked.groupBy("group").agg(F.min("best").alias("top"), F.count(F.lit(1)).alias("nodes"), F.max("rows").alias("most"))
    many = best.where("nodes > 1 or most > 1").select("group", F.col("top.row").alias("stays"))
    several = materialize(ranked.join(many, "group").select("node", "stays"), "near-several")
    bits = sieve(several.select("node"))
    by_chance, _ = split_by_sieve(nodes.select("node", F.col("best.row").alias("row")), "node", bits)
    back = several.select(F.col("stays").alias("row")).distinct().unionByName(by_chance.join(several, "node", "left_anti").select("row"))
    back = materialize(back, "near-back")
    maybe, sure = split_by_sieve(tagged, "node", bits)
    stay, _ = split_by_sieve(maybe, "row", sieve(back))
    discard(nodes, member, links)
    kept = [f"c{i}" for i in range(len(names))]
    return sure.select(kept).unionByName(stay.join(back, "row", "left_semi").select(kept)).toDF(*names)
