"""Search and cited answers end to end."""

import datetime as dt

from postquill import services
from postquill.operators import asking


def test_search_and_ask(spark):
    chunks = spark.createDataFrame([("m1:0", "the price of copper is ten dollars"), ("m1:1", "copper is delivered in may"), ("m2:0", "lunch on friday"), ("m3:0", None)], "id string, text string")
    asked = spark.createDataFrame([(1, "copper price"), (2, "unheard")], "qid int, query string")
    found = [(r["qid"], r["key"], r["rank"], r["chunk_ids"]) for r in asking.search(asked, chunks, "bm25").collect()]
    assert found == [(1, "m1", 1, ["m1:0", "m1:1"])]
    messages = spark.createDataFrame([("m1", "a@x", dt.datetime(2001, 5, 1), None), ("m2", "b@x", None, "s")], "dedup_key string, sender string, date_utc timestamp, subject string")
    got = {r["qid"]: r for r in asking.ask(asked, chunks, messages, services.echo_model, retriever="bm25").collect()}
    assert got[1]["cited"] == [1] and not got[1]["refused"] and got[1]["answer"].endswith("[1]")
    assert got[2]["refused"] and got[2]["answer"] is None
