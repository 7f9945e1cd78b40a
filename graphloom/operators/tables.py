"""Upserts, deletes and retention over Parquet-backed tables, as DataFrame -> DataFrame.

Nothing is changed in place: each function returns the table's next version, to be written under
a new path or partition and swapped by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], seq: str, rules: dict[str, str] | None = None) -> DataFrame:
    """Insert or update by key; of several updates of a key the one with the greatest `seq` counts.

    Rules per column: replace (default), coalesce (a null update keeps the old value),
    keep_first (an existing value stays), set_null. Null keys are keys of their own.
    """
    rules = rules or {}
    new = latest(updates, keys, [F.col(seq).desc()])
    a, b = base.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    old_there, new_there = F.col("a.__here").isNotNull(), F.col("b.__here").isNotNull()
    a, b = base.withColumn("__here", F.lit(1)).alias("a"), new.withColumn("__here", F.lit(1)).alias("b")

    def value(c: str) -> Column:
        was, now = F.col(f"a.{c}"), F.col(f"b.{c}")
        both = {"replace": now, "coalesce": F.coalesce(now, was), "keep_first": was, "set_null": F.lit(None)}[rules.get(c, "replace")]
        return F.when(old_there & new_there, both).when(new_there, now).otherwise(was).alias(c)

    return a.join(b, on, "full_outer").select(*(value(c) for c in base.columns))


def merge_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Merge nodes by (label, id): the name is replaced, properties overlaid (null removes one, old ones survive)."""
    a, b = nodes.alias("a"), new.alias("b")
    old, add = F.coalesce("a.props", F.create_map().cast("map<string,string>")), F.coalesce("b.props", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(add), k))
    props = F.map_concat(kept, F.map_filter(add, lambda k, v: v.isNotNull()))
    return a.join(b, ["label", "id"], "full_outer").select("label", "id", F.coalesce("b.name", "a.name").alias("name"), props.alias("props"))


def merge_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges after the merge, counts): new edges need both ends; the last of several counts by `seq`."""
    ids = nodes.select("id").distinct()
    sound = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    counts = new.agg(F.count(F.lit(1)).alias("attempted")).crossJoin(sound.agg(F.count(F.lit(1)).alias("written")))  # single rows
    return upsert(edges, sound, ["type", "src", "dst"], "seq"), counts


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without `gone(id)` and the edges on them."""
    left = nodes.join(gone, "id", "left_anti")
    e = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left, e


def orphans(nodes: DataFrame, edges: DataFrame, keep: tuple[str, ...] = ("Repo", "Service")) -> DataFrame:
    """Nodes without any edge, other than those of the labels that always stay."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return nodes.where(~F.col("label").isin(*keep)).join(ends, "id", "left_anti")


def fold_status(events: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """State after all events of a key: each column's last value that is not null."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = events.select(key, seq, *(F.last(c, ignorenulls=True).over(w).alias(c) for c in columns))
    return latest(last, [key], [F.col(seq).desc()]).drop(seq)


def replace_rows(base: DataFrame, batch: DataFrame, key: str, seq: str) -> DataFrame:
    """Delete-then-insert by key; within a batch the last row of a key wins."""
    return base.join(batch.select(key).distinct(), key, "left_anti").unionByName(latest(batch, [key], [F.col(seq).desc()]).select(base.columns))


def delete_where(base: DataFrame, gone: Column) -> DataFrame:
    """Rows for which the predicate is not true (null keeps a row)."""
    return base.where(~F.coalesce(gone, F.lit(False)))


def zero_filled(counts: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """Counts with every name of a closed vocabulary, absent ones as 0."""
    spark = counts.sparkSession
    return spark.createDataFrame([(n,) for n in names], f"{key} string").join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def reservoir(samples: DataFrame, key: str, value: str, seq: str, size: int = 1024) -> DataFrame:
    """count, sum, min, max and nearest-rank p50/p95/p99 of each key's newest `size` samples.

    A percentile is sorted[min(n-1, floor(p*n))].
    """
    w = Window.partitionBy(key).orderBy(F.col(seq).desc())
    # the reservoir is bounded, so the list is
    kept = samples.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= size)
    lists = kept.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.array_sort(F.collect_list(value)).alias("s"))
    at = lambda p: F.element_at("s", (F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))) + 1).cast("int"))
    return lists.select(key, "n", F.round("total", 4).alias("total"), "least", "most", *(at(p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)))
