import pytest

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "x"), (2, "Alpha beta gamma delta epsilon zeta eta theta", "y"), (2, "Alpha beta gamma delta epsilon zeta eta theta", "y"),
    (3, None, None), (4, "", "z"), (None, "no id here at all", "q"), (None, "no id here at all", "q"), (None, None, None), (5, "one", "w"), (6, "two words", None),
    (7, LONG, "l"), (8, "é ü 日本 \U0001f600 text", "u"), (9, " \n\t ", "b"), (10, "a" * 50_000, "r"), (-3, "negative id", "n"),
]
#: Names that operators use inside.
CLASHES = (
    "fp", "label", "row", "spans", "found", "count", "sequence_id", "offset", "sequences", "lower_bound", "n", "kind", "t", "start", "task", "order_hash", "form",
    "text_", "text_sent", "toxicity", "toxic_spans", "met", "__met", "__text", "__many", "__copy", "__print", "__id", "__label", "__fp", "b_email", "w_ip", "others",
    "c0", "c1", "node", "size", "blocks", "check", "rank", "best", "sent", "at", "words", "stays", "pieces", "piece", "length", "train", "block", "ids", "fingerprint", "n_chars",
)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def clashing(odd_docs, tables, tmp_path_factory):
    """The odd tables with columns of every name used inside."""
    import shutil

    d = str(tmp_path_factory.mktemp("clash"))
    odd_docs.write.parquet(f"{d}/documents.parquet")
    for x in ("labels", "benchmark"):
        shutil.copytree(f"{tables}/{x}.parquet", f"{d}/{x}.parquet")
    return d


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def tables(spark, odd_docs, tmp_path_factory):
    """A folder of tables whose documents are the odd ones."""
    d = str(tmp_path_factory.mktemp("odd"))
    odd_docs.select("doc_id", "text", "lang").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (99, 1)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "beta gamma delta epsilon zeta"), (2, None), (3, ""), (None, "two words")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d
