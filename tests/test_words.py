"""Word edges, folds and line ends of patterns as SQL has them, over texts that are not ASCII."""

import duckdb

from graphloom.functions.text import redacted, sql_regex
from graphloom.operators.router import RULES, classify

TEXTS = (
    "équeue", "queué", "的queue的", "a queue", "queues", "_queue", "Kafka topic", "aKafka topic", "uſes x", "when a x clicks", "when a\rb clicks",
    "when a\nb clicks", "which table", "İs queue", "user-journey", "end to end", "endtoend", "", "THE TEAḾ", "éwho owns",
)


def test_rules_match_as_in_sql(spark):
    con, rows = duckdb.connect(), spark.createDataFrame([(t,) for t in TEXTS], "q string")
    for _, patterns in RULES:
        for p in patterns:
            mine = {r["q"] for r in rows.where(rows.q.rlike(sql_regex(p))).collect()}
            assert mine == {t for t in TEXTS if con.execute("SELECT regexp_matches(?, ?)", [t, f"(?i){p}"]).fetchone()[0]}, p


def test_accents_beside_a_word(spark):
    rows = spark.createDataFrame([("équeue",), ("queué",)], "q string")
    assert {r["class"] for r in classify(rows, "q").collect()} == {"ops"}


def test_redaction_beside_accents(spark):
    rows = spark.createDataFrame([("étoken: abc\u000bd",), ("paſsword = x",), ("token\u000b: abc",)], "t string")
    assert [r[0] for r in rows.select(redacted(rows.t)).collect()] == ["étoken: [REDACTED]", "paſsword = [REDACTED]", "token\u000b: abc"]
