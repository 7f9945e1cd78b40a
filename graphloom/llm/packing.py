"""Best-fit packing with certified bin counts.

Documents become pieces of at most `capacity` tokens. Pieces are dealt to groups of bounded
size by a hash of their row; in each group best-fit decreasing (BFD) fills bins, and a lower
bound from dual-feasible functions says how few bins could do. A group that meets its bound is
certified and keeps its bins but for the emptiest one, which other groups may fill. A group
with a gap keeps only its full bins. The documents of all other bins are exchanged: dealt anew
to fewer groups and packed again, until one group holds the rest or the rounds end. The result
names the number of sequences and the bound for all pieces together, so what is left is known.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents, free_names, map_texts, materialize
from graphloom.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
GROUP = 20_000  # pieces of one group
ROUNDS = 4


def lower_bound(sizes, capacity: int) -> int:
    """Fewest bins that can hold integer `sizes`, by dual-feasible functions."""
    import numpy as np

    value, count = np.unique(np.asarray(sizes, np.int64), return_counts=True)
    return lower_bound_of(dict(zip(value.tolist(), count.tolist())), capacity)


def lower_bound_of(histogram: dict[int, int], capacity: int) -> int:
    """Fewest bins for sizes given as {size: count}.

    Takes the best of the continuous bound, u_k (Fekete and Schepers, rounding x*(k+1)/C down
    unless it is whole) and the threshold functions (above C - e: a bin; below e: nothing).
    """
    import numpy as np

    if not histogram:
        return 0
    value, count = (np.array(x, np.int64) for x in zip(*sorted(histogram.items())))
    best = -(-int((value * count).sum()) // capacity)
    for k in range(1, 33):
        scaled = value * (k + 1)
        u = np.where(scaled % capacity == 0, value * k, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((u * count).sum()) // (k * capacity)))
    for e in value[value * 2 <= capacity].tolist():
        big = int(count[value > capacity - e].sum())
        mid = (value >= e) & (value <= capacity - e)
        best = max(best, big + -(-int((value * count)[mid].sum()) // capacity))
    return best


def best_fit_decreasing(sizes, capacity: int):
    """(bin, offset) of each size, as two lists: largest first, each into the fullest bin that it fits."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with room r exists
    bins, bin_of, offset_of = 0, [0] * len(sizes), [0] * len(sizes)
    for i in order:
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        bin_of[i], offset_of[i] = b, capacity - room
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bin_of, offset_of


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of `docs(doc_id, text)`.

    A document is its ids and id 0 at its end. Longer ones than `capacity` are cut so that only
    the first piece may be shorter. Null and empty texts are id 0 alone.
    """
    path = path or tokenizer_path()

    def make():
        encode, dtype = encoder(path)
        width = dtype.itemsize

        def cut(text):
            ids = memoryview(encode(text or "") + bytes(width))
            n = len(ids) // width
            first = n % capacity or min(n, capacity)
            edges = [0, *range(first, n + 1, capacity)]
            return ([{"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a * width : b * width])} for i, (a, b) in enumerate(zip(edges, edges[1:]))],)

        return cut

    fields = "pieces array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
    return map_texts(docs, make, fields).select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*")


def _pack_group(capacity: int, round_: int, last: bool):
    """Arrow group function: pieces -> sequence_id and place, or no sequence_id for pieces given away; a group's first row counts its kept bins."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        sizes = table.column("length").to_pylist()
        bin_of, offset_of = (np.array(x, np.int64) for x in best_fit_decreasing(sizes, capacity))
        size = np.array(sizes, np.int64)
        fill = np.bincount(bin_of, size).astype(np.int64)
        certified = len(fill) == lower_bound(sizes, capacity)
        stays = np.full(len(fill), True) if last else (fill == capacity) | certified
        if certified and not last and fill.min() < capacity:
            stays[fill.argmin()] = False
        ids = (round_ << 56) + (key[0].as_py() << 24) + bin_of
        return pa.table({
            **{c: table.column(c) for c in ("row", "length")},
            "sequence_id": pa.array(np.where(stays[bin_of], ids, -1)), "offset": pa.array(offset_of),
            "bins": pa.array(np.where(np.arange(len(size)) == 0, stays.sum(), 0)),
        })

    return run


def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """The rows of `found` (any columns, `length` among them) with sequence_id, offset, sequences and lower_bound.

    sequences and lower_bound are the same in every row: how many sequences there are, and how
    many the dual-feasible functions prove to be needed for all pieces together; their difference
    bounds what better packing could save. Lengths are 1 to `capacity`. An empty table gives no
    rows; repeated rows are packed each on its own. Other columns are kept; where one bears an
    added column's name, the added one gets an underscore.
    """
    kept = found.columns
    names = free_names(found, "sequence_id", "offset", "sequences", "lower_bound")
    rows = materialize(found.toDF(*(f"c{i}" for i in range(len(kept)))).withColumns({"length": F.col(f"c{kept.index('length')}"), "row": F.monotonically_increasing_id()}), "pieces")
    of_length = rows.groupBy("length").count().collect()  # at most `capacity` rows
    bound = lower_bound_of({r["length"]: r["count"] for r in of_length}, capacity)
    left, done, bins = rows.select("row", "length"), [], 0
    for round_ in range(rounds):
        n = left.count()
        if not n:
            break
        groups = -(-n // (group << round_))
        last = groups == 1 or round_ == rounds - 1
        dealt = left.select("row", "length", F.pmod(F.xxhash64(F.lit(round_), "row"), F.lit(groups)).alias("g"))
        schema = "row long, length long, sequence_id long, offset long, bins long"
        packed = materialize(dealt.groupBy("g").applyInArrow(_pack_group(capacity, round_, last), schema), "packed")
        bins += packed.agg(F.sum("bins")).first()[0]
        done.append(packed.where("sequence_id >= 0"))
        left = packed.where("sequence_id < 0").select("row", "length")
    placed = reduce(DataFrame.unionByName, done) if done else rows.select("row", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    whole = rows.join(placed.select("row", "sequence_id", "offset"), "row")
    return whole.select(*(f"c{i}" for i in range(len(kept))), "sequence_id", "offset", F.lit(bins).cast("long"), F.lit(bound).cast("long")).toDF(*kept, *names)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack(pieces(documents(spark, sf_dir)))
