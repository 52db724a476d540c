"""Operators on small literal tables: fixtures with answers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from postquill.functions import dates, text
from postquill.functions.predicates import is_bulk
from postquill.operators import chunking, corpus, dense, fusion, incremental, lexical, metrics, rerank, sampling, threads
from postquill.operators.components import connected_components
from postquill.operators.evaluation import answer_scores, misses

MSG = "dedup_key string, message_id string, in_reply_to string, references string, subject_norm string, sender string, recipients string, cc string, date_utc timestamp"


def message(key, subject, who, to, day, reply=""):
    import datetime as dt

    when = None if day is None else dt.datetime(2000, 12, 1, tzinfo=dt.UTC) + dt.timedelta(days=day)
    return (key, f"<{key}@x>", reply, "", subject, who, to, "", when)


def threads_of(spark, rows, **limits):
    out = {r["dedup_key"]: r["thread_id"] for r in threads.assign_threads(spark.createDataFrame(rows, MSG), **limits).collect()}
    stats = threads.thread_stats(spark.createDataFrame(rows, MSG), **limits).first().asDict()
    return out, stats


def test_header_and_subject_links(spark):
    out, stats = threads_of(spark, [message("m2", "pricing model", "b", "a", 1, "<m1@x>"), message("m1", "pricing model", "a", "b", 0)])
    assert out == {"m1": "m1", "m2": "m1"} and (stats["linked_by_header"], stats["linked_by_heuristic"]) == (1, 0)
    out, stats = threads_of(spark, [message("m1", "quarterly audit", "a", "b", 0), message("m2", "quarterly audit", "b", "a", 2)])
    assert out["m2"] == "m1" and (stats["linked_by_header"], stats["linked_by_heuristic"]) == (0, 1)
    for other in (message("m2", "meeting", "x", "y", 1), message("m2", "meeting", "b", "a", 200), message("m2", "meeting", "b", "a", None)):
        assert threads_of(spark, [message("m1", "meeting", "a", "b", 0), other])[0]["m2"] == "m2"
    assert threads_of(spark, [message("m1", "fyi", "a", "b", 0), message("m2", "fyi", "b", "a", 1)])[0]["m2"] == "m2"


def test_oversized_bucket_is_left_alone(spark):
    _, stats = threads_of(spark, [message(f"m{i:03d}", "petition", f"s{i}", "boss", i % 60) for i in range(60)])
    assert stats["oversized_buckets_skipped"] == 1 and stats["singletons"] == 60
    _, stats = threads_of(spark, [message(f"m{i}", "quarterly audit", "a", "b", i) for i in range(5)])
    assert stats["largest_thread"] == 5 and stats["threads"] == 1


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(200, 230)] + [(7, 7), (None, 3)] + [(8, 9), (9, 8)]
    out = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(out.values()) == {100, 1, 8} and len(out) == 61 + 31 + 2
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sample_takes_whole_threads(spark):
    import datetime as dt

    rows = [(f"t{t}", dt.datetime(2000 + t % 2, 1, 1)) for t in range(60) for _ in range(3)]
    m = spark.createDataFrame(rows, "thread_id string, date_utc timestamp")
    one, two = (sorted(r["thread_id"] for r in sampling.sample_threads(m, 30, "7").collect()) for _ in range(2))
    assert one == two and 30 <= 3 * len(one) <= 36
    assert sampling.sample_threads(m, 500, "7").count() == 60


def test_first_copies_and_bulk_order(spark):
    rows = [("k", "2", "hello " * 9), ("k", "1", "ok"), ("j", "3", "hello " * 9)]
    m = spark.createDataFrame(rows, "dedup_key string, source_path string, body_new string").withColumns({"sender": F.lit("a@x"), "subject": F.lit("s"), "has_list_unsubscribe": F.lit(False)})
    kept = corpus.dedup_and_filter(m).collect()
    assert [r["dedup_key"] for r in kept] == ["j"]  # the bulk first copy hides the second
    assert corpus.dedup_and_filter(m, seen=spark.createDataFrame([("j",)], "dedup_key string")).count() == 0
    assert m.where(is_bulk()).count() == 1


def test_thread_packing_lengths(spark):
    rows = [("t", f"m{i}", i, " ".join(["w"] * n)) for i, n in enumerate([300, 200, 100, 512, 600, 10])]
    m = spark.createDataFrame(rows, "thread_id string, dedup_key string, pos int, body string")
    got = sorted((r["chunk_id"], r["n_tokens"]) for r in chunking.thread_aware(m, F.col("body"), ["pos"]).collect())
    assert got == sorted([("m0:0", 500), ("m2:1", 100), ("m3:2", 512), ("m4:0", 512), ("m4:1", 88), ("m5:3", 10)])
    assert chunking.rebuild(chunking.whole(m, F.col("body")), spark.createDataFrame([("m1:0",)], "chunk_id string")).first()["n_tokens"] == 200
    with pytest.raises(Exception, match="cannot rebuild"):
        chunking.rebuild(chunking.whole(m, F.col("body")), spark.createDataFrame([("zz:0",)], "chunk_id string")).collect()


def run(spark, name, *pairs):
    return spark.createDataFrame([(1, name, i, float(s), n + 1) for n, (i, s) in enumerate(pairs)], "qid int, run string, id string, score double, rank int")


def test_fusion_fixtures(spark):
    d, s = run(spark, "d", ("a", 3), ("b", 2), ("c", 1)), run(spark, "s", ("c", 3), ("a", 2), ("z", 1))
    ids = [r["id"] for r in fusion.reciprocal_rank(fusion.union_runs(d, s)).orderBy("rank").collect()]
    assert ids[0] == "a" and set(ids) == {"a", "b", "c", "z"}
    scaled = fusion.reciprocal_rank(fusion.union_runs(d.withColumn("score", F.col("score") * 1e5), s))
    assert [r["id"] for r in scaled.orderBy("rank").collect()] == ids
    tie = fusion.reciprocal_rank(fusion.union_runs(run(spark, "d", ("b", 1), ("a", 0)), run(spark, "s", ("a", 1), ("b", 0)))).orderBy("rank")
    assert [r["id"] for r in tie.collect()] == ["a", "b"]
    flat = fusion.weighted(fusion.union_runs(run(spark, "d", ("a", 5), ("b", 5)), run(spark, "s", ("a", 1))), {"d": 0.5, "s": 0.5})
    assert {r["id"]: r["score"] for r in flat.collect()} == {"a": 1.0, "b": 0.5}
    with pytest.raises(Exception, match="no weight"):
        fusion.weighted(fusion.union_runs(d, s), {"d": 1.0}).collect()
    chunks = run(spark, "d", ("m3:0", 9), ("m1:2", 8), ("m3:1", 7), ("m1:0", 6), ("m2:0", 5))
    assert [r["id"] for r in fusion.collapse(chunks, text.key_of_chunk("id")).orderBy("rank").collect()] == ["m3", "m1", "m2"]
    shown = fusion.collapse_display(run(spark, "d", ("m1:0", 3), ("m2:0", 2), ("m1:1", 1)), text.key_of_chunk("id"), spark.createDataFrame([("m1:0", "one two"), ("m1:1", "two")], "id string, text string"), 2).orderBy("rank").collect()
    assert shown[0]["chunk_ids"] == ["m1:0", "m1:1"] and shown[0]["text"] == "one two" and shown[1]["text"] == ""


def test_dense_and_rerank(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, vector array<float>")
    for f in (dense.search, dense.search_batch):
        assert [(r["id"], r["score"]) for r in f(v, q, 10).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.6), ("c", 0.0)]
    passages = [("m3:0", "lunch plans friday", 9), ("m2:0", "quarterly audit findings houston", 8), ("m1:0", "pricing model discount tier decision", 7), ("m4:0", "discount tier pricing memo", 6), ("m5:0", "unrelated vendor invoice", 5)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in passages if i != "m5:0"], "id string, text string")
    asked = spark.createDataFrame([(1, "pricing discount tier")], "qid int, query string")
    out = rerank.rerank(run(spark, "d", *[(i, s) for i, _, s in passages]), asked, texts, 5).orderBy("rank").collect()
    assert [r["id"] for r in out] == ["m1:0", "m4:0", "m3:0", "m2:0", "m5:0"]
    assert all(a["score"] >= b["score"] for a, b in zip(out, out[1:]))
    assert dense.norm_problems(v.select(F.col("id"), F.array(F.lit(2.0), F.lit(0.0)).alias("embedding"))).count() == 3


def test_bm25_pads_and_clamps(spark):
    c = spark.createDataFrame([("a", "pricing pricing memo"), ("b", "audit"), ("c", "")], "id string, text string")
    q = spark.createDataFrame([(1, "pricing memo"), (2, "zebra")], "qid int, query string")
    out = lexical.bm25(c, q, k=10)
    assert {(r["qid"], r["id"], r["rank"]) for r in out.collect()} == {(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1), (2, "b", 2), (2, "c", 3)}
    tf, dl, avg = 2, 3, 4 / 3
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    want = idf * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avg)) + idf * 1 / (1 + 1.5 * (0.25 + 0.75 * dl / avg))
    assert out.where("qid = 1 AND id = 'a'").first()["score"] == round(want, 6)


def test_metric_fixtures(spark):
    runs = spark.createDataFrame([(1, i, n + 1) for n, i in enumerate("abcde")] + [(2, i, n + 1) for n, i in enumerate("xbc")], "qid int, id string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "e"), (2, "b"), (2, "z")], "qid int, id string")
    cls = spark.createDataFrame([(1, "semantic"), (2, "entity"), (3, "unanswerable")], "qid int, query_class string")
    per = {r["qid"]: r for r in metrics.per_query(runs, cls, rel, recalls=(3,)).collect()}
    assert math.isclose(per[1]["ndcg"], (1 / math.log2(3) + 1 / math.log2(6)) / (1 + 1 / math.log2(3)))
    assert (per[2]["recall_3"], per[2]["rr"]) == (0.5, 0.5) and per[3]["ndcg"] is None and per[3]["recall_3"] is None
    lat = spark.createDataFrame([("a", float(i)) for i in range(1, 101)], "g string, latency_ms double")
    assert metrics.latency(lat, ["g"]).first()[1:] == (51.0, 96.0)
    pairs = lambda rows: spark.createDataFrame(rows, "a string, b string")
    assert metrics.cohens_kappa(pairs([("s", "s")] * 9 + [("s", "u")]), "a", "b").first()["kappa"] == 0.0
    assert metrics.cohens_kappa(pairs([("s", "s"), ("u", "u")]), "a", "b").first()["kappa"] == 1.0
    assert metrics.cohens_kappa(pairs([("s", "s")]), "a", "b").first()["kappa"] is None


def test_miss_categories(spark):
    rows = [("q1", "pricing memo", "semantic", 1, 25, None, "", "pricing memo"), ("q2", "x", "semantic", 1, 3, None, "", ""), ("q3", "pricing", "semantic", 1, None, 4, "", None), ("q4", "pricing", "temporal", 2, None, None, "BAD_LABEL: no", None), ("q5", "pricing", "semantic", 1, None, None, "", "none")]
    t = spark.createDataFrame(rows, "query_id string, query string, query_class string, n_relevant int, found_at int, best_chunk_rank int, notes string, document string")
    assert {r["query_id"]: r["category"] for r in misses(t).collect()} == {"q1": "ranking", "q3": "chunk_boundary", "q4": "bad_label", "q5": "vocabulary"}
    v = spark.createDataFrame([("q", [1], "supported"), ("q", [], "partially_supported"), ("q", [2], "unsupported"), ("q", [], "not_a_claim")], "query_id string, cited array<int>, verdict string")
    assert answer_scores(v).first()[1:] == (3, 0.5, 0.5)


def test_retry_and_upsert(spark):
    jobs = spark.sql("SELECT 1 AS id, 'running' AS status, 2 AS attempts, TIMESTAMP '2024-01-01 00:00:00' AS run_after")
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    assert incremental.failed(jobs, now).select(F.col("run_after").cast("string")).first()[0] == "2024-01-01 01:02:00"
    assert incremental.failed(jobs.withColumn("attempts", F.lit(3)), now).first()["status"] == "failed"
    t = spark.createDataFrame([("m1", "send", 1)], "k string, text string, v int")
    new = spark.createDataFrame([("m1", "send", 2), ("m2", "x", 3), ("m2", "x", 4)], "k string, text string, v int")
    assert {(r["k"], r["v"]) for r in incremental.insert_ignore(t, new, ["k", "text"], F.col("v")).collect()} == {("m2", 3)}
    assert {(r["k"], r["v"]) for r in incremental.upsert(t, new, ["k", "text"], F.col("v")).collect()} == {("m1", 2), ("m2", 4)}


def test_window_and_zone(spark):
    ts = spark.sql("SELECT TIMESTAMP '2001-10-29 23:00:00' AS ts")
    assert str(ts.select(dates.local_day("ts")).first()[0]) == "2001-10-29"
    assert str(ts.select(dates.local_day("ts", F.lit("Asia/Karachi"))).first()[0]) == "2001-10-30"
    asked = spark.sql("SELECT 'due next week' AS q, CAST(NULL AS DATE) AS d")
    assert asked.select(dates.window("q", "d").alias("w")).first()["w"] is None


def test_text_functions(spark):
    row = spark.sql("SELECT '```json\n[\"a\", \"b\"]\n```' AS fenced, '{\"queries\": [\"c\"]}' AS held, '**insufficient_context**' AS no, 'x' AS bad")
    got = row.select(text.string_list("fenced", "queries").alias("a"), text.string_list("held", "queries").alias("b"), text.is_refusal("no").alias("c"), text.clamp_unit("bad").alias("d"), text.sent_label(F.lit("2001-10-30").cast("date")).alias("e")).first()
    assert (got["a"], got["b"], got["c"], got["d"], got["e"]) == (["a", "b"], ["c"], True, 0.5, "2001-10-30 (Tuesday)")
