"""Shared pieces of the corpus operators: inputs, scratch tables, splits, row filters, components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOCAL_SCRATCH = "/tmp/checkpoints/graphloom"
#: Scratch tables written within calls of pipeline stages and not yet removed.
_of_stages: list[str] = []
_in_stage = False
#: Words of 64 bits in a sieve: 2**20, so 8 MB at most, whatever the number of keys.
SIEVE_WORDS = 1 << 20
_ROW_WORDS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is set and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or _LOCAL_SCRATCH


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet into the shared folder and read it again.

    The shuffle files of the write are removed when it ends; the table itself survives
    lost executors. discard() removes it, as does the next stage if it belongs to a stage.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if _in_stage:
        _of_stages.append(path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialize() returned, once their last reader is done."""
    for table in tables:
        _remove(table.sparkSession, table._scratch)
        if table._scratch in _of_stages:
            _of_stages.remove(table._scratch)


@contextmanager
def stage_scratch(spark: SparkSession):
    """For the body of a pipeline stage: removes what earlier stages have left and notes what this one writes."""
    global _in_stage
    while _of_stages:
        _remove(spark, _of_stages.pop())
    _in_stage = True
    try:
        yield
    finally:
        _in_stage = False


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """`wanted` names, each with underscores added until no column of `df` bears it (case apart)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and others: a struct of all other columns, so that no name can clash."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    others = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest))) if rest else F.struct(F.lit(0).alias("none"))
    return docs.select("doc_id", "text", others.alias("others"))


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `docs` from rows of packed(docs); `changed` ones are taken as given."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    at = {c: F.col(f"others.c{i}") for i, c in enumerate(rest)} | {"doc_id": F.col("doc_id"), "text": F.col("text")} | changed
    return rows.select(*(at[c].alias(c) for c in docs.columns))


def sieve(keys: DataFrame) -> DataFrame:
    """Bits of the hashed `keys` (one column of longs), packed: (at, words array<long>), 8 MB at most."""
    import numpy as np

    place = F.pmod(F.xxhash64(F.lit("sieve"), keys.columns[0]), F.lit(SIEVE_WORDS * 64))
    bits = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))

    def pack(key, table):
        import pyarrow as pa

        words = np.zeros(_ROW_WORDS, np.int64)
        words[table.column("w").to_numpy() % _ROW_WORDS] = table.column("b").to_numpy()
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "words": pa.array([words.tolist()], pa.list_(pa.int64()))})

    return bits.groupBy(F.floor(F.col("w") / _ROW_WORDS).alias("at")).applyInArrow(pack, "at long, words array<long>")


def split_by_sieve(rows: DataFrame, key: str, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose `key` may be among a sieve's keys, all other rows); nothing of `rows` is shuffled.

    As long as the keys are few against the sieve's bits, hardly another row passes for one of them.
    """
    at, words = free_names(rows, "at", "words")
    place = F.pmod(F.xxhash64(F.lit("sieve"), key), F.lit(SIEVE_WORDS * 64))
    marked = rows.join(F.broadcast(bits.select(F.col("at").alias(at), F.col("words").alias(words))), F.floor(place / (64 * _ROW_WORDS)) == F.col(at), "left")
    word = F.element_at(words, (F.shiftright(place, 6) % _ROW_WORDS + 1).cast("int"))
    hit = F.coalesce(F.call_function("shiftrightunsigned", word, (place % 64).cast("int")) % 2 != 0, F.lit(False))
    return marked.where(hit).select(rows.columns), marked.where(~hit).select(rows.columns)


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node on an edge of `edges(a long, b long)`; label = smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond"), which keep at most as many edges as they got and end after about
    log(n) rounds. Each round is cut by a written table. Only a count and a hash come to the driver.
    """

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        return r["n"], r["h"]

    # a > b on every edge from here on
    e = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low2, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low2.select("a", F.col("m").alias("b")))
            .distinct()
        )
        before, e = e, materialize(small, name)
        discard(before)
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def map_texts(docs: DataFrame, make, fields: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per row of `docs`: its `keep` columns and what make()(text) returns, as columns `fields` (DDL).

    make() runs once in each task and returns the function of one whole text (null: None).
    Rows travel in Arrow batches; nothing is shuffled. Added columns must not bear the name of a kept one.
    """
    (sent,) = free_names(docs.select(*keep), "text_sent")
    rows = docs.select(*keep, F.col(text).alias(sent))
    added = StructType.fromDDL(fields)
    schema = StructType([*docs.select(*keep).schema, *added])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        f = make()
        types = [to_arrow_type(x.dataType) for x in added]
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                found = [f(x.as_py()) for x in part.column(len(keep))]
                made = [pa.array([r[i] for r in found], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], schema.names)

    return rows.mapInArrow(run, schema)


def join_spans(spans, order: tuple[str, ...]) -> str:
    """kind:start:end of (kind, start, end), by start, then kind as in `order`, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order.index(x[0]), x[2])))
