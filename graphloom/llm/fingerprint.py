"""Canonical exact digests of documents, in DataFrame functions only.

A text's canonical form is Unicode-normalised (NFKC), case-folded (and normalised again), with
runs of white space folded to one space and none at the ends. Its fingerprint is two independent
64-bit xxHashes. Documents meet in buckets of equal fingerprints; inside a bucket the canonical
bytes are compared by their least and greatest value, which are equal if and only if all are.
Both are combined on the map side, so a bucket of many copies costs a row a task. A bucket that
fails is grouped by the canonical text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import documents, materialize

RANGES = 64
ROWS_A_RANGE = 2000


def canonical(text: Column) -> Column:
    """Canonical form; null as empty. Unicode's own folding is asked for only where a text has other than ASCII characters."""
    text = F.coalesce(text, F.lit(""))
    composed = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True))
    whole = F.when(text.rlike(r"[^\x00-\x7F]"), composed(folded)).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(whole, r"(?U)\s+", " "))


def digest(form: Column) -> Column:
    """32 lowercase hex digits of two xxHash64 with different seeds."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), form)), 16, "0") for seed in ("first", "second"))))


def exact_groups(docs: DataFrame) -> DataFrame:
    """(fingerprint, form, group_id, group_size) of the canonical texts of `docs(doc_id, text)`.

    One row per distinct canonical text; `form` is that text only where two texts share a
    fingerprint, else null. group_id is the smallest doc_id. Null texts count as empty ones,
    repeated rows count each, rows without doc_id count but give no id.
    """
    rows = docs.select("doc_id", canonical(F.col("text")).alias("form")).withColumn("fingerprint", digest(F.col("form")))
    compared = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size"), F.min("form").alias("lo"), F.max("form").alias("hi"))
    sizes = materialize(compared.select("fingerprint", "group_id", "group_size", (F.col("lo") != F.col("hi")).alias("mixed")), "digest-buckets")
    mixed = sizes.where("mixed").select("fingerprint")
    alike = sizes.where("not mixed").select("fingerprint", F.lit(None).cast("string").alias("form"), "group_id", "group_size")
    if mixed.isEmpty():
        return alike
    apart = rows.join(mixed, "fingerprint", "left_semi").groupBy("fingerprint", "form").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    return alike.unionByName(apart.select(alike.columns))


def with_next(docs: DataFrame, values: list[str], rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """`docs` with next_<value> of the row that follows by descending doc_id, the first after the last.

    Rows of equal doc_id, and rows without one (they come last), follow by descending `order_hash`,
    which `docs` must hold. Rows are dealt to ranges of ids once; the row that opens a range is
    copied to the end of the range before, so no task sees more than its range.
    """
    n, bounds = docs.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", [i / RANGES for i in range(RANGES + 1)], 10_000)).first()
    parts = max(1, -(-n // (RANGES * rows_a_range)))
    bounds = sorted(set(bounds or [0]))
    spread = ((F.shiftright("order_hash", 48) + 32768) * (parts * 4) / 65536).cast("long")  # of rows without id
    part = F.lit(None).cast("long")
    zone = F.lit(0)
    for i, (lo, hi) in reversed(list(enumerate(zip(bounds, bounds[1:] or [bounds[0] + 1]), 1))):
        inside = F.col("doc_id") < hi if i < len(bounds) - 1 else F.lit(True)
        zone = F.when(inside, F.lit(i)).otherwise(zone) if i < len(bounds) - 1 else F.lit(i)
        slot = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((F.col("doc_id") - lo) / F.lit(max(1, hi - lo)) * parts)))
        part = F.when(inside, slot).otherwise(part) if i < len(bounds) - 1 else slot
    zoned = docs.withColumns({"__zone": F.when(F.col("doc_id").isNull(), 0).otherwise(zone), "__part": F.when(F.col("doc_id").isNull(), spread).otherwise(part)})

    top = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "order_hash")
    heads = materialize(zoned.select("__zone", "__part", top.alias("top")).groupBy("__zone", "__part").agg(F.max("top").alias("top")), "next-heads")
    # each range's successor: the range below in its zone, else the topmost range of the zone below, else the very first
    by_zone = heads.groupBy("__zone").agg(F.max_by("top", "__part").alias("zone_top"))
    around = by_zone.select("__zone", F.coalesce(F.lag("zone_top").over(Window.orderBy("__zone")), F.max_by("zone_top", "__zone").over(Window.orderBy("__zone").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("below"))  # RANGES + 1 rows at most
    follows = heads.withColumn("lower", F.lag("top").over(Window.partitionBy("__zone").orderBy("__part"))).join(around, "__zone").select("__zone", "__part", F.coalesce("lower", "below").alias("t"))
    wanted = follows.select("__zone", "__part", F.coalesce(F.col("t.doc_id"), F.lit(0)).alias("k"), F.col("t.some").alias("s"), F.col("t.order_hash").alias("o"))
    opens = (
        docs.select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNotNull().alias("s"), F.col("order_hash").alias("o"), *values)
        .join(wanted, ["k", "s", "o"])
        .select("__zone", "__part", *values)
    )
    cols = docs.columns
    ghosts = opens.select("__zone", "__part", F.lit(True).alias("__ghost"), *(F.col(c) if c in values else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in cols))
    both = zoned.select("__zone", "__part", F.lit(False).alias("__ghost"), *cols).unionByName(ghosts)
    w = Window.partitionBy("__zone", "__part").orderBy("__ghost", F.col("doc_id").desc_nulls_last(), F.col("order_hash").desc())
    return both.select("__ghost", *cols, *(F.lead(v).over(w).alias(f"next_{v}") for v in values)).where("not __ghost").drop("__ghost")


def edited_text(text: Column, n_chars: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by as many (or all) first ones of `following`."""
    half = F.floor(n_chars / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n_chars - half).cast("int")), F.substring(following, F.lit(1), half))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint, edited text's digest and exact group of every row of documents."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    groups = exact_groups(docs)
    rows = docs.withColumns({"fingerprint": digest(canonical(F.col("text"))), "order_hash": F.xxhash64("text")})
    found = with_next(rows, ["text", "fingerprint"])
    found = found.withColumn("n_chars", F.length("text").cast("long"))
    found = found.withColumn("edited", edited_text(F.col("text"), F.col("n_chars"), F.col("next_text")))
    likeness = lambda a, b: (F.col(a) == F.col(b)).cast("double")  # noqa: E731  an exact digest knows only equal and unequal
    found = found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        digest(canonical(F.col("edited"))).alias("edited_fingerprint"), F.col("next_fingerprint").alias("next_fingerprint"), "text",
    )
    mixed = groups.where("form is not null")
    plain = found.drop("text").join(groups.where("form is null").drop("form"), "fingerprint", "left")
    if not mixed.isEmpty():
        apart = found.withColumn("form", canonical(F.col("text"))).drop("text").join(mixed, ["fingerprint", "form"]).drop("form")
        plain = plain.where("group_size is not null").unionByName(apart.select(plain.columns))
    return plain.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
        "group_id", "group_size",
    )
