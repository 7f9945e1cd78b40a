"""Configuration scans, validation, blame and fallback: edge cases on small inputs."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import changes, config_scan, router, validation


def test_checked_fills_defaults():
    assert validation.checked("search_codebase", {"query": "x", "other": 1}) == {"query": "x", "limit": 20}
    assert validation.checked("get_dependencies", {"service": "a", "depth": 10}) == {"service": "a", "depth": 10}


@pytest.mark.parametrize(
    ("request_", "values", "said"),
    [
        ("search_codebase", {"query": ""}, "query: too short"),
        ("search_codebase", {}, "query: required"),
        ("search_codebase", {"query": "x", "limit": 101}, "limit: too large"),
        ("search_codebase", {"query": "x", "limit": 1.5}, "limit: not int"),
        ("search_codebase", {"query": "x", "limit": True}, "limit: not int"),
        ("search_codebase", {"query": "x", "type": "service"}, "type: not a choice"),
        ("get_dependencies", {"service": 3, "depth": 0}, "service: not str; depth: too small"),
        ("settings", {"maxRepoSizeMb": 0}, "maxRepoSizeMb: too small"),
    ],
)
def test_checked_reports(request_, values, said):
    with pytest.raises(ValueError, match=said):
        validation.checked(request_, values)


def test_violations_of_nulls(spark):
    rows = spark.createDataFrame([(None, 1), ("a", None), ("", 9)], "name string, n int")
    got = validation.violations(rows, {"name": validation.Field(required=True, least_length=1), "n": validation.Field(int, high=5)})
    assert {tuple(r["problems"]) for r in got.collect()} == {("name: required",), ("name: too short", "n: too large")}
    assert validation.violations(rows.limit(0), {"n": validation.Field(int, low=1)}).count() == 0


def test_config_scan_edges(spark):
    files = [
        (".env", None), (".env", ""), (".env.local", 'A="mysql://x"\n=redis://y\nCB_URL=\nMY_DB_HOST=1\npg_db_url = z'),
        ("config/a.json", '["amqp:\\/\\/q", {"k": {"redis://key": "\\\\"}}]'), ("config/deep/a.json", '"redis://x"'), ("config/b.json", "{redis://"), ("config/c.yaml", "redis://"),
        ("compose.yaml", "IMAGE: mongo:6\nimage: myredis"),
    ]
    got = config_scan.config_databases(spark.createDataFrame([("r", *f) for f in files], "repo_url string, path string, content string"))
    assert {(r["path"], r["database"]) for r in got.collect()} == {
        (".env.local", "MySQL"), (".env.local", "Redis"), (".env.local", "PostgreSQL"), ("config/a.json", "RabbitMQ"), ("compose.yaml", "MongoDB")}


def test_blame_of_odd_ranges(spark):
    lines = spark.createDataFrame([("f", i, s, s) for i, s in enumerate("aabba", 1)], "path string, line int, sha string, author string")
    ranges = spark.createDataFrame([("f", 2, 5), ("f", 2, 5), ("f", 3, 2), ("g", 1, 9), (None, 1, 1)], "path string, first int, last int")
    got = changes.blame_ranges(lines, ranges).select("from_line", "to_line", "sha").collect()
    assert sorted(map(tuple, got)) == [(2, 2, "a"), (3, 4, "b"), (5, 5, "a")]


def test_merge_risks_without_files(spark):
    asked = spark.createDataFrame([(1, "t", None, None, None, None, None, None)], "mr int, title string, description string, draft boolean, has_conflicts boolean, pipeline string, approvals_left int, approvers int")
    none = spark.createDataFrame([], "mr int, path string, diff string")
    assert [r["risks"] for r in changes.merge_risks(asked, changes.file_churn(none)).collect()] == [[]]


def test_model_answers_only_where_asked(spark):
    rows = spark.createDataFrame([(1, "code", 0.6), (2, "unknown", 0.0), (3, "api", None)], "id int, class string, confidence double")
    answers = spark.createDataFrame([(1, "flow", 0.9), (2, "flow", 0.8), (2, "api", 0.7), (3, "nothing", 1.0)], "id int, class string, confidence double")
    got = router.with_model_answers(router.with_fallback(rows), answers, "id").orderBy("id")
    assert [(r["class"], r["asks_model"]) for r in got.collect()] == [("code", False), ("flow", True), ("api", True)]
    assert not router.with_fallback(rows, enabled=False).where(F.col("asks_model")).count()
