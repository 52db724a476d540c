"""Mail parsing, files, services and streaming ingestion."""

from pyspark.sql import functions as F

from postquill import services
from postquill.schemas import CHUNKS
from postquill.sources import mail, tables
from postquill.sources.changes import MailChanges
from postquill.streaming import ingest, windows

RAW = """Message-ID: <1@x>
Date: Tue, 5 Dec 2000 09:14:00 -0800 (PST)
From: Sara Shackleton <sara.shackleton@enron.com>
To: mark.taylor@enron.com, Rick.Buy@enron.com, mark.taylor@enron.com
Subject: RE: Fwd: pricing model

The new paragraph.

-----Original Message-----
From: somebody
> quoted
"""


def test_maildir(spark, tmp_path):
    (tmp_path / "maildir/shackleton-s/sent").mkdir(parents=True)
    (tmp_path / "maildir/shackleton-s/sent/1").write_text(RAW)
    (tmp_path / "maildir/shackleton-s/sent/.hidden").write_text("x")
    (tmp_path / "maildir/shackleton-s/sent/2").write_bytes(b"Subject: =?utf-8?q?caf=C3=A9?=\r\nDate: nonsense\r\n\r\ncaf\xe9 \x93quoted\x94")
    rows = {r["source_path"]: r for r in mail.read_maildir(spark, str(tmp_path / "maildir")).collect()}
    assert set(rows) == {"shackleton-s/sent/1", "shackleton-s/sent/2"}
    one, two = rows["shackleton-s/sent/1"], rows["shackleton-s/sent/2"]
    assert one["sender"] == "sara.shackleton@enron.com" and one["recipients"] == "mark.taylor@enron.com;rick.buy@enron.com"
    assert one["subject_norm"] == "pricing model" and one["body_new"] == "The new paragraph." and one["dedup_key"].startswith("sha256:")
    assert (one["owner"], one["folder"]) == ("shackleton-s", "sent") and str(one["date_utc"]) == "2000-12-05 17:14:00"
    assert two["subject"] == "café" and "“quoted”" in two["body"] and two["date_utc"] is None


def test_base64_without_padding(spark):
    import base64

    raw = base64.urlsafe_b64encode(RAW.encode()).decode().rstrip("=")
    assert mail.read_raw_base64(spark.createDataFrame([("p/a/1", raw)], "source_path string, raw string")).first()["message_id"] == "<1@x>"


def test_eval_file(spark, tmp_path):
    f = tmp_path / "queries.jsonl"
    f.write_text('# note\n\n{"query_id": "q1", "query": "x", "query_class": "semantic", "relevant_message_ids": ["a"]}\n{"query": "y", "query_class": "entity"}\nnot json\n')
    rows = tables.read_eval_queries(spark, str(f)).collect()
    assert [r["problem"] for r in rows] == [None, "missing field query_id", "bad JSON"] and rows[0]["relevant_message_ids"] == ["a"]


def test_files_round_trip(spark, tmp_path):
    assert tables.read_if_there(spark, str(tmp_path / "none"), CHUNKS).count() == 0
    t = spark.sql("SELECT 'a:0' AS chunk_id, 'x' AS text, 1L AS line UNION ALL SELECT 'a:0', 'y', 2L")
    tables.write_json_lines(t, str(tmp_path / "c"), gzip=True)
    assert tables.read_text_cache(spark, str(tmp_path / "c")).first()["text"] == "y"
    tables.write_parquet(t.withColumn("dedup_key", F.lit("k")), str(tmp_path / "p"))
    plan = tables.read_messages(spark, str(tmp_path / "p"), ["text"], "k")
    assert plan.columns == ["text"] and "EqualTo(dedup_key,k)" in plan._jdf.queryExecution().toString()


def test_stream_ingest_is_idempotent(spark, tmp_path):
    spark.dataSource.register(MailChanges)
    root = str(tmp_path)

    def once():
        stream = spark.readStream.format("mail_changes").option("service", "postquill.sources.changes:DemoService").option("pages", 3).load()
        q = stream.writeStream.foreachBatch(lambda df, i: ingest.ingest_batch(spark, mail.parse_messages(df), root, i)).option("checkpointLocation", f"{root}/checkpoint").trigger(once=True).start()
        q.awaitTermination(120)
        return {r["source_path"] for r in spark.read.parquet(f"{root}/messages").collect()}

    first = once()
    assert len(first) == 7 and once() == first  # three of ten are copies
    batch = mail.parse_messages(spark.createDataFrame([(p, b) for _, p, b in __import__("postquill.sources.changes", fromlist=["DemoService"]).DemoService().since(0, 10)], "source_path string, content binary"))
    ingest.ingest_batch(spark, batch, root, 99)
    assert spark.read.parquet(f"{root}/messages").count() == 7


def test_streaming_windows_match_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = windows.tumbling(stream, "ts", "1 day", "event_type", "value", "1 hour").writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    want = {(str(r[0]), r[1], r[2]) for r in windows.tumbling(e, "ts", "1 day", "event_type", "value").collect()}
    assert {(str(r[0]), r[1], r[2]) for r in spark.table("days").collect()} == want


def test_services(spark):
    q = spark.createDataFrame([(1, "what price"), (2, "nothing")], "qid int, query string")
    s = spark.createDataFrame([(1, 1, "a@x", "2001-01-01", "s", "the price is ten dollars per unit")], "qid int, rank int, sender string, date string, subject string, text string")
    got = {r["qid"]: r for r in services.cited_answers(q, s, services.echo_model).collect()}
    assert got[2]["refused"] and not got[1]["refused"] and got[1]["cited"] == [1] and got[1]["invalid"] == []

    def broken(prompts):
        raise RuntimeError("quota")

    answered, new = services.complete(q.select("qid", F.col("query").alias("prompt")), broken, "m")
    assert answered.where("answer IS NOT NULL").count() == 0 and new.count() == 0
    cached, new = services.complete(q.select("qid", F.col("query").alias("prompt")), lambda p: [x.upper() for x in p], "m")
    again, fresh = services.complete(q.select("qid", F.col("query").alias("prompt")), broken, "m", cache=new.cache())
    assert fresh.count() == 0 and {r["answer"] for r in again.collect()} == {"WHAT PRICE", "NOTHING"}
    t = services.transform(q, F.when(F.col("qid") == 1, '{"queries": ["cost", "price list"]}'), "multi_query").orderBy("qid").collect()
    assert t[0]["dense_texts"] == ["what price", "cost", "price list"] and t[0]["fired"] and t[1]["degraded"] and t[1]["dense_texts"] == ["nothing"]


def test_a_bad_header_word_spoils_no_other():
    from email import message_from_bytes

    from postquill.sources.mail import body, decoded, header

    m = message_from_bytes(b"Subject: =?utf-8?q?caf=C3=A9?= and =?utf-8?q?=FF=FE?= =?nowhere?q?=E9t=E9?=\nX: plain\nY: =?utf-8?b?a?=\n\nbody \xe9")
    got = header(m, "Subject")
    assert got.startswith("caf\u00e9") and "and" in got and "\ufffd" in got and got.endswith("\u00e9t\u00e9")
    assert header(m, "X") == "plain" and header(m, "none") == "" and header(m, "Y")
    assert body(m) == "body \u00e9" and decoded(b"\x81\xe9") == "\x81\u00e9" and decoded(b"\x93q\x94") == "\u201cq\u201d"
