"""Chains over a model, the queue, ingestion and sinks on small tables."""

import contextlib
import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from postquill.functions import dates
from postquill.functions.predicates import DATE_LANGUAGE
from postquill.operators import ablation, chunking, extraction, judging, reporting, routing, scoping
from postquill.schemas import MESSAGES
from postquill.sources import sinks, versions
from postquill.streaming import ingest, jobs

ANSWERS = "query_id string, query string, query_class string, answer string, refused boolean, invalid array<int>, sources array<struct<n int, sender string, date string, subject string, text string>>"


def judge(prompts):
    out = []
    for p in prompts:
        if "addresses the question" in p:
            out.append('{"score": 2}' if "copper" in p else '{"score": 9}')
        else:
            out.append("no json" if "late" in p.partition("\n\n[1]")[0] else '```json\n{"verdict": "Supported", "why": "said"}\n```')
    return out


def test_judging(spark):
    s = [(1, "a@x", "2001-05-01", "s", "copper is ten"), (2, None, None, None, None)]
    rows = [("q1", "copper price", "semantic", "Copper is ten [1]. It was late [2]. Nothing cited here.", False, [], s), ("q2", "x", "unanswerable", None, True, None, []), ("q3", "y", "entity", "All fine [1].", False, [7], s), ("q4", "z", "entity", None, True, None, None)]
    a = spark.createDataFrame(rows, ANSWERS)
    got, _ = judging.claim_verdicts(judging.claims(a), judge)
    assert sorted((r["query_id"], r["n_claim"], r["cited"], r["verdict"]) for r in got.collect()) == [("q1", 0, [1], "supported"), ("q1", 1, [2], "unsupported"), ("q1", 2, [], "not_a_claim"), ("q3", 0, [1], "supported")]
    rel, _ = judging.relevance(a, judge)
    assert {r["query_id"]: r["relevance"] for r in rel.collect()} == {"q1": 2, "q3": None}
    report = judging.judged_report(a, judge).first()
    assert report["groundedness"] == 0.75 and report["answer_relevance"] == 1.0 and report["refusal_on_controls"] == 1.0 and report["refused_answerable"] == 1 and report["fabricated_citations"] == 0.5
    assert judging.judged_report(a.limit(0), judge).first()["groundedness"] is None


def test_routing(spark):
    q = spark.createDataFrame([(1, "what is due this week"), (2, "tell me things"), (3, "hm"), (4, None)], "qid int, query string")
    said = lambda prompts: ['{"route": "Hybrid"}' if "things" in p else "?" for p in prompts]
    got = {r["qid"]: r for r in routing.routed(q, said).collect()}
    assert [(got[i]["route"], got[i]["decided_by"], got[i]["confidence"], got[i]["llm_calls"]) for i in (1, 2, 3, 4)] == [("sql", "rules", 0.9, 0), ("hybrid", "llm", 0.7, 1), ("both", "default", 0.0, 1), ("both", "default", 0.0, 1)]
    assert got[3]["uses_sql"] and got[3]["uses_retrieval"] and not got[2]["uses_sql"]
    assert {r["decided_by"]: r["n"] for r in reporting.decided_by(routing.routed(q)).collect()} == {"rules": 1, "default": 3}


def test_extraction(spark):
    day = dt.datetime(2001, 10, 30, 9)
    m = spark.createDataFrame([("m1", "a", "b", "s", day, "please send the deck by friday"), ("m2", "a", "b", "s", day, "please send the rest"), ("m3", "a", None, None, None, "lunch was nice"), ("m4", None, None, None, None, None)], "dedup_key string, sender string, recipients string, subject string, date_utc timestamp, body_new string")
    one = {"text": "send the deck", "kind": " Review ", "direction": "mutual", "due_phrase": "friday", "confidence": 2}
    model = lambda prompts: [json.dumps([one]) if "deck" in p else "broken" for p in prompts]
    found, seen, _ = extraction.extract(m, model)
    assert [(r["message_id"], r["kind"], r["direction"], r["due_at"], r["confidence"]) for r in found.collect()] == [("m1", "review", "mutual", dt.date(2001, 11, 2), 1.0)]
    assert {r["message_id"]: (r["passed"], r["failed"]) for r in seen.collect()} == {"m1": (True, False), "m2": (True, True), "m3": (False, False), "m4": (False, False)}
    stats = reporting.extraction_stats(seen, found).first()
    assert (stats["messages_seen"], stats["messages_called"], stats["commitments"], stats["with_due_date"]) == (4, 2, 1, 1)
    runs = spark.createDataFrame([("m1", "send deck", "big"), ("m1", "pay invoice", "big"), ("m1", "send the deck", "small")], "message_id string, text string, model string")
    got = extraction.compare_models(runs).first()
    assert (got["local"], got["ceiling"], got["both"], got["ceiling_only"]) == ("small", "big", 1, 1)
    assert extraction.compare_models(runs.where("model = 'big'")).count() == 0


def test_ablation(spark):
    chunks = spark.createDataFrame([("m1:0", "copper price ten dollars"), ("m2:0", "lunch friday"), ("m3:0", "copper mine")], "id string, text string")
    q = spark.createDataFrame([(1, "copper price", "a"), (2, "lunch", "b")], "qid int, query string, query_class string").withColumns({"dense_texts": F.array("query"), "sparse_texts": F.array("query", F.lit("copper"))})
    rel = spark.createDataFrame([(1, "m1"), (2, "m2")], "qid int, id string")
    arms = [ablation.Arm("whole", "org/hash", "bm25"), ablation.Arm("whole", "org/hash", "hybrid_weighted", 0.7, "L6@20"), ablation.Arm("whole", "org/hash", "hybrid_rrf", transform="multi_query")]
    got = ablation.compare(arms, {"whole": chunks}, q, rel, 10).where("query_class = 'all'").collect()
    assert {r["arm"]: r["rr"] for r in got if r["retriever"] != "hybrid_rrf"} == {"whole | hash | bm25": 1.0, "whole | hash | hybrid_weighted | +rerank:L6@20": 1.0}
    assert [r["n_answerable"] for r in got] == [2, 2, 2] and {r["dense_weight"] for r in got} == {None, 0.7}
    assert arms[2].label == "whole | hash | hybrid_rrf | +multi_query"
    with pytest.raises(ValueError):
        ablation.per_query(ablation.Arm("whole", "m", "bm25", rerank="none such"), chunks, q, rel)


def test_queue(spark, tmp_path):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    gone: list = []
    d = jobs.Dispatcher(spark, f"file://{tmp_path}/jobs", gone.append)
    seen: list = []
    d.register("initial_sync")(lambda job: seen.append(job["user_id"]))

    @d.register("extract_commitments")
    def broken(job):
        raise RuntimeError("down")

    assert not d.run_once(now)
    d.enqueue(now, ("initial_sync", "u1"))
    assert d.run_once(now) and seen == ["u1"] and gone == ["u1"]
    assert [(r["id"], r["type"], r["status"]) for r in d.jobs().orderBy("id").collect()] == [(1, "initial_sync", "done"), (2, "backfill_history", "queued"), (3, "extract_commitments", "queued")]
    assert d.run_once(now) and d.run_once(now) and not d.run_once(now)
    got = {r["type"]: r for r in d.jobs().collect()}
    assert got["backfill_history"]["status"] == "failed" and got["extract_commitments"]["status"] == "queued" and got["extract_commitments"]["error"] == "RuntimeError: down"
    left = iter([False, True])
    assert d.poll(lambda: next(left), 0.0) == 1


def test_rethread_and_reindex(spark, tmp_path):
    root = f"file://{tmp_path}/mail"
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/cp")
    names = [f.split()[0] for f in MESSAGES.split(", ")]

    def batch(*rows):
        return spark.createDataFrame([tuple({"recipients": "b@x", "cc": "", "subject": "s", "subject_norm": "s", "in_reply_to": "", "references": "", "has_list_unsubscribe": False, "body": r["body_new"], "sender": "a@x", "source_path": r["dedup_key"], **r}.get(n) for n in names) for r in rows], MESSAGES)

    day = lambda d: dt.datetime(2001, 5, d)
    ingest.ingest_batch(spark, batch({"dedup_key": "k1", "message_id": "<1@x>", "date_utc": day(1), "body_new": "the price of copper is ten dollars"}, {"dedup_key": "k3", "message_id": "<3@x>", "in_reply_to": "<2@x>", "date_utc": day(3), "body_new": "that is too much money for it"}), root, 0)
    assert {r["dedup_key"]: r["thread_id"] for r in ingest.rethread(spark, root).collect()} == {"k1": "k1", "k3": "k3"}
    first = ingest.reindex(spark, root)
    ingest.ingest_batch(spark, batch({"dedup_key": "k2", "message_id": "<2@x>", "in_reply_to": "<1@x>", "date_utc": day(2), "body_new": "copper was nine dollars last week"}), root, 1)
    assert {r["thread_id"] for r in ingest.rethread(spark, root).collect()} == {"k1"}
    assert ingest.reindex(spark, root) != "" and first != ""
    kept = versions.read(spark, f"{root}/chunks")
    assert [(r["chunk_id"], r["n_tokens"]) for r in kept.collect()] == [("k1:0", 20)]
    with pytest.raises(ValueError):
        chunking.chunked("none such", kept, F.col("text"), [])


def test_small_pieces(spark, tmp_path):
    w = spark.sql("SELECT 'what is due next week' AS q, DATE '2001-10-30' AS d UNION ALL SELECT 'anything overdue', DATE '2001-10-30' UNION ALL SELECT 'why', DATE '2001-10-30'").select("q", dates.window("q", "d").alias("w"))
    got = {r["q"]: r["l"] for r in w.select("q", dates.window_label(F.col("w")).alias("l")).collect()}
    assert got["what is due next week"] == "2001-11-05 to 2001-11-11 (7 days)" and got["anything overdue"].endswith(" plus anything already overdue") and got["why"] is None
    assert spark.sql("SELECT DATE '2001-10-30' AS d").select(dates.midnight_utc("d").cast("string")).first()[0] == "2001-10-30 00:00:00"
    assert [r[0] for r in spark.sql("SELECT * FROM VALUES ('by the 5th'), ('EOD please'), ('undue care') AS t(x)").select(F.col("x").rlike(DATE_LANGUAGE)).collect()] == [True, True, False]
    turns = spark.createDataFrame([("c1", 1), ("c2", 1)], "conversation_id string, turn int")
    owners = spark.createDataFrame([("c1", "u1"), ("c2", "u2")], "id string, user_id string")
    assert [r["conversation_id"] for r in scoping.conversation_turns(turns, owners, "u1").collect()] == ["c1"]
    m = spark.createDataFrame([("a@pub.org",), (None,)], "sender string")
    assert scoping.holds_marker(m, ("@pub.org",)) and not scoping.holds_marker(m, ("@else",)) and not scoping.holds_marker(m, ())
    folder = str(tmp_path)

    @contextlib.contextmanager
    def connect():
        with open(os.path.join(folder, f"part-{os.getpid()}"), "a") as f:
            yield lambda row: f.write("\t".join(map(str, row)) + "\n")

    v = spark.createDataFrame([("a", [0.123456789, 1.0]), ("b", [2.0, 3.0])], "id string, e array<double>")
    sinks.copy_rows(v, ["id"], "e", 2, connect)
    lines = sorted(line for name in os.listdir(folder) for line in open(os.path.join(folder, name)).read().splitlines())
    assert lines == ["a\t[0.1234568,1]", "b\t[2,3]"]
    with pytest.raises(ValueError):
        sinks.vector_text([1.0], 2)
