"""Headings of documents: rows of one path are documents of their own, and long keys keep their headings."""

from graphloom.catalog import extract as catalog
from graphloom.operators import extract as x


def test_documents_of_one_path_are_read_apart(spark):
    texts = {"rst": "Part\n====\n\nNext\n----\n", "md": "# One\n```\nopen fence\n", "prisma": "model A {\n  id Int @id\n}\n"}
    files = spark.createDataFrame([("r", f"a.{end}", t) for end, t in texts.items() for _ in range(3)], "repo_url string, path string, content string")
    rows = sorted((r["path"], r["level"], r["text"], r["line"]) for r in x.document_headings(files).collect())
    assert rows == sorted(3 * [("a.rst", 1, "Part", 1), ("a.rst", 2, "Next", 4), ("a.md", 1, "One", 1)])


def test_documents_of_suppliers_with_long_keys(spark):
    supplier = spark.createDataFrame([(k, "Supplier") for k in (4, 400, 4_000, 4_000_000, 4_000_000_000)], "s_suppkey long, s_name string")
    rows = sorted((r["text"], r["level"], r["line"]) for r in x.document_headings(catalog._of_documents(supplier)).collect())
    expected = [(text.replace("%", str(k)), level, line) for k in (4, 400, 4_000, 4_000_000, 4_000_000_000) for level, text, line in catalog.DOCUMENTS[0][2]]
    assert rows == sorted(expected)
