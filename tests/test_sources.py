"""Sources, caches and facade on small inputs."""

import json
import os

import pytest

from graphloom.operators.service import QueryCache, run_sql
from graphloom.sources.cases import load_cases, write_lines
from graphloom.sources.files import scan


def test_scan(spark, tmp_path):
    root = tmp_path / "repo1"
    for path, text in {"src/a.ts": "let x", "node_modules/b.ts": "no", "c.min.js": "no", "d.bin": "no", "README.md": "# hi"}.items():
        os.makedirs(root / os.path.dirname(path), exist_ok=True)
        (root / path).write_text(text)
    kept, skipped = scan(spark, str(root), "r")
    assert sorted(r["path"] for r in kept.collect()) == ["README.md", "src/a.ts"]
    assert {r["reason"]: r["count"] for r in skipped.collect()} == {"directory": 1, "generated": 1, "extension": 1}


def test_cases(spark, tmp_path):
    good = [{"id": "1", "question": "who owns x", "expectedClass": "ownership", "goldCitations": []}]
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text(json.dumps([good[0] | {"expectedClass": "nonsense"}]))
    cases = load_cases(spark, str(tmp_path / "good.json"))
    assert [r["id"] for r in cases.collect()] == ["1"]
    with pytest.raises(Exception, match="unknown class"):
        load_cases(spark, str(tmp_path / "bad.json")).collect()
    for _ in range(2):
        write_lines(cases, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_cache_and_guard(spark):
    now = [0.0]
    cache = QueryCache(2, 10, lambda: now[0])
    cache.put("a", 1, "r")
    cache.put("b", 2, "r")
    cache.put("c", 3, "q")
    assert cache.get("a") is None and cache.get("b") == 2
    now[0] = 11
    assert cache.get("b") is None and cache.drop_repo("q") == 1 and not cache.entries
    with pytest.raises(ValueError):
        run_sql(spark, "INSERT INTO t VALUES (1)")


def test_replay_of_no_files_and_of_several(spark, tmp_path):
    from pyspark.sql import functions as F

    from graphloom.streaming.events import replay

    (tmp_path / "none").mkdir()
    empty = replay(spark, str(tmp_path / "none"), "k string", lambda s: s, "empty")
    assert empty.columns == ["k"] and empty.count() == 0
    for i in range(3):
        spark.createDataFrame([("a",), (str(i),)], "k string").coalesce(1).write.mode("append").parquet(str(tmp_path / "some"))
    assert replay(spark, str(tmp_path / "some"), "k string", lambda s: s, "rows", only="*.parquet").count() == 6
    counts = replay(spark, str(tmp_path / "some"), "k string", lambda s: s.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "counts", mode="complete", only="*.parquet")
    assert {tuple(r) for r in counts.collect()} == {("a", 3), ("0", 1), ("1", 1), ("2", 1)}
