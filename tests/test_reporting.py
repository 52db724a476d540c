"""Scopes and report tables on small tables with odd rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postquill.operators import reporting, scoping


def test_scopes(spark):
    day = lambda d: dt.datetime(2001, 5, d)
    m = spark.createDataFrame([("a", "t1", day(1)), ("b", "t1", day(20)), ("c", "t2", day(21)), ("d", None, None)], "dedup_key string, thread_id string, date_utc timestamp")
    q = spark.createDataFrame([("temporal", ["a", "zz"]), ("semantic", ["c"]), ("entity", None)], "query_class string, relevant_message_ids array<string>")
    keys = lambda df: sorted(r["dedup_key"] for r in df.collect())
    assert keys(scoping.eval_scoped(m, q)) == ["a", "b"] and scoping.eval_scoped(m, q).columns == m.columns
    assert keys(scoping.since(m, F.lit(day(20)))) == ["b", "c"] and keys(scoping.since(m, None, 3)) == ["a", "b", "c"]
    assert keys(scoping.recent(m, F.lit(day(22)))) == ["b", "c"]
    zones = spark.createDataFrame([("t1", "Europe/Paris"), ("t2", "")], "thread_id string, zone string")
    assert {r["dedup_key"]: r["zone"] for r in scoping.lookup(m, zones, "thread_id", "zone", "UTC").collect()} == {"a": "Europe/Paris", "b": "Europe/Paris", "c": "UTC", "d": "UTC"}
    chunks = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x"), ("b", 0, None)], "dedup_key string, ordinal int, text string")
    assert {r["dedup_key"]: r["text"] for r in scoping.message_texts(chunks).collect()} == {"a": "x y", "b": ""}


def test_report_tables(spark):
    assert reporting.table_name("fixed", "org/Model-1.5") == "chunks_fixed__model_1_5"
    with pytest.raises(ValueError):
        reporting.table_name("fixed; drop", "m")
    a = spark.createDataFrame([(True, [], []), (False, [1], []), (False, [1], [9]), (None, [], [])], "refused boolean, cited array<int>, invalid array<int>")
    assert [r[0] for r in a.select(reporting.grounded_shape(F.col("refused"), F.col("cited"), F.col("invalid"))).collect()] == [True, True, False, False]
    s = spark.sql("SELECT array(named_struct('n', 1, 's', 'x'), named_struct('n', 2, 's', 'y')) AS sources, array(2) AS cited")
    assert [x["s"] for x in s.select(reporting.cited_sources(F.col("sources"), F.col("cited"))).first()[0]] == ["y"]
    r = spark.createDataFrame([("rules",), ("rules",), ("llm",), (None,)], "decided_by string")
    assert {x["decided_by"]: x["share"] for x in reporting.decided_by(r).collect()} == {"rules": 0.5, "llm": 0.25, None: 0.25}
    arms = spark.createDataFrame([("s", 20, 128, 150.0), ("s", 20, 256, 199.0), ("l", 50, 256, 300.0)], "model string, top_k int, passage_tokens int, ms double")
    assert reporting.best_affordable(arms).first()["ms"] == 199.0 and reporting.best_affordable(arms, 1).count() == 0
    assert reporting.newest(arms, "ms").first()["model"] == "l"
    f = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "x")], "message_id int, f_text string")
    g = spark.createDataFrame([(1, 1, "x", "late"), (1, 0, "x", "first"), (3, 0, "z", "none")], "message_id int, g_order int, g_text string, g_due string")
    assert [(x["message_id"], x["g_due"]) for x in reporting.paired_with_gold(f, g, F.col("f_text") == F.col("g_text")).collect()] == [(1, "first")]
    m = spark.createDataFrame([(True,), (False,), (True,), (False,)], "passed boolean")
    c = spark.createDataFrame([("2001-05-01",), (None,)], "due_at string")
    assert tuple(reporting.extraction_stats(m, c).first()) == (4, 2, 2, 0.5, 2, 1)
    assert reporting.extraction_stats(m.limit(0), c).first()["prefilter_pass_rate"] is None
    assert reporting.markdown_table(spark.sql("SELECT 'a|b' AS x, 0.5D AS y, null AS z"), ["x", "y", "z"]).splitlines() == ["| x | y | z |", "|-|-|-|", "| a\\|b | 0.500 | - |"]
