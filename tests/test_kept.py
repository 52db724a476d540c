"""What is kept and carried on: segments, threads, keyed state, joined streams, sketches, counters."""

import random

import pytest
from pyspark.sql import functions as F

from postquill.operators import lexical, observed, segments, sketches, threads
from postquill.streaming import ingest, pairs, state


def run(df):
    return sorted((r["qid"], r["rank"], str(r["id"]), r["score"]) for r in df.collect())


QUERIES = [(1, "red apple pie"), (2, "green"), (3, "the of"), (4, "apple apple tart"), (5, None), (6, "nothing that is there")]


def test_segments_through_changes(spark, tmp_path):
    rng = random.Random(2)
    words = ["red", "green", "apple", "pie", "tart", "blue", "sky", "Apple", "the"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 30])))
    asked = spark.createDataFrame(QUERIES, "qid int, query string")
    root, now = str(tmp_path), {}
    for step in range(4):
        changes = [(str(rng.randrange(60)), text(), rng.random() < 0.25) for _ in range((40, 12, 3, 25)[step])]
        if step == 1:
            changes += [("7", None, False), ("8", "", False), ("unknown", None, True), ("9", "x", None), ("7", "apple", False)]
        last = {}
        for i, t, gone in changes:
            last[i] = max(last.get(i, (False, "")), (bool(gone), t or ""))
        for i, (gone, t) in last.items():
            now.pop(i, None)
            if not gone:
                now[i] = t
        segments.apply(spark.createDataFrame(changes, "id string, text string, gone boolean").withColumn("term", F.lit("clash")), root, fan=2, stripe=3)
        whole = spark.createDataFrame(list(now.items()), "id string, text string")
        for first in (1,) if step % 2 else (1000,):
            found, reads = segments.search(spark, root, asked, 4, first=first)
            assert run(found) == run(lexical.bm25(whole, asked, 4, keep_zero=False)), (step, first)
            assert all(0 < r["rows_read"] <= r["rows_all"] for r in reads.collect())
    kinds = [r["kind"] for r in segments._manifest(spark, root)]
    assert kinds.count("segment") < 4  # some were merged


def test_a_change_leaves_what_was_written(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text", F.lit(False).alias("gone"))
    segments.apply(docs, str(tmp_path))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("postings/**/*.parquet")}
    segments.apply(docs.where("id = '3'").withColumn("text", F.lit("short new text")), str(tmp_path))
    after = {p: p.stat().st_mtime_ns for p in tmp_path.glob("postings/**/*.parquet")}
    assert before.items() <= after.items()
    new = spark.read.parquet(*[str(p) for p in after if p not in before])
    assert new.agg(F.sum("n")).first()[0] == 3
    found, _ = segments.search(spark, str(tmp_path), spark.createDataFrame([(1, "short new text")], "qid int, query string"), 1)
    assert found.first()["id"] == "3"
    empty, _ = segments.search(spark, str(tmp_path / "none"), spark.createDataFrame([(1, "x")], "qid int, query string"), 1)
    assert empty.count() == 0


def test_few_rows_are_read_for_rare_terms(spark, tmp_path):
    rows = [(f"{i:04d}", " ".join(["common"] * (1 + i % 5) + [f"filler{i % 7}"] * (i % 40)) + (" rare" if i % 500 == 3 else ""), False) for i in range(3000)]
    segments.apply(spark.createDataFrame(rows, "id string, text string, gone boolean"), str(tmp_path))
    asked = spark.createDataFrame([(1, "rare common")], "qid int, query string")
    found, reads = segments.search(spark, str(tmp_path), asked, 5, first=8)
    assert run(found) == run(lexical.bm25(spark.createDataFrame(rows, "id string, text string, gone boolean"), asked, 5, keep_zero=False))
    read = reads.first()
    assert read["rows_read"] < read["rows_all"] / 4


MESSAGE = "dedup_key string, message_id string, in_reply_to string, references string, subject_norm string, date_utc timestamp, sender string, recipients string, cc string"


def _mail(seed, n=260):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parent = rng.randrange(n)
        out.append((
            f"k{i:03d}", f"<m{i % 240}@x>" if rng.random() < 0.9 else None, f"<m{parent % 240}@x>" if rng.random() < 0.15 else "", f"<m{rng.randrange(n)}@x> <gone@x>" if rng.random() < 0.05 else None,
            rng.choice(["", "hi", *[f"subject {k}" for k in range(40)], "subject 1", "subject 1"]), None if rng.random() < 0.05 else f"2020-01-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:00:00", f"p{rng.randrange(6)}@x", f"p{rng.randrange(6)}@x", "",
        ))
    return out


@pytest.mark.parametrize("seed", [1])
def test_threads_after_each_batch(spark, seed):
    """Late messages come between others, join threads, and make a bucket a broadcast."""
    mail = spark.createDataFrame([(*r[:5], None, *r[6:]) for r in _mail(seed)], MESSAGE)
    dates = {r[0]: r[5] for r in _mail(seed)}
    mail = mail.drop("date_utc").join(spark.createDataFrame(list(dates.items()), "dedup_key string, d string").select("dedup_key", F.col("d").cast("timestamp").alias("date_utc")), "dedup_key").cache()
    limits = {"window_seconds": 3 * 86400, "max_bucket": 9}
    batch = F.pmod(F.xxhash64("dedup_key"), F.lit(3))
    known, found, joined = mail.limit(0), None, 0
    for b in range(3):
        new = mail.where(batch == b)
        before = found if found is not None else known.select("dedup_key", F.col("dedup_key").alias("thread_id"))
        changed = threads.update_threads(known, before, new, **limits).cache()
        joined += changed.join(before.withColumnRenamed("thread_id", "old"), "dedup_key").where("old <> thread_id").count()
        rows = {r[0]: r[1] for r in before.collect()} | {r[0]: r[1] for r in changed.collect()}
        known = known.unionByName(new)
        assert rows == {r[0]: r[1] for r in threads.assign_threads(known, **limits).collect()}
        if b == 2:
            assert changed.count() < len(rows)
        found = spark.createDataFrame(list(rows.items()), "dedup_key string, thread_id string")
    assert joined


def test_ingested_batches_keep_threads_and_index(spark, sf, tmp_path):
    """Batches of mail, one run twice: threads and index are those of everything at once."""
    from postquill.operators.chunking import chunked
    from postquill.schemas import MESSAGES

    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    mail = d.select(
        F.concat(F.lit("<m"), "doc_id", F.lit("@x>")).alias("message_id"), F.format_string("%03d", "doc_id").alias("dedup_key"), F.expr("timestamp'2020-01-01 00:00:00' + make_interval(0,0,0,0,cast(doc_id * 7 % 60 as int))").alias("date_utc"),
        F.lit("a@x").alias("sender"), F.lit("b@x").alias("recipients"), F.lit("").alias("cc"), F.concat(F.lit("subject "), F.col("doc_id") % 17).alias("subject_norm"), F.substring("text", 1, 300).alias("body_new"), F.col("doc_id").cast("string").alias("source_path"),
    )
    missing = [c for c in MESSAGES.split(", ") if c.split()[0] not in mail.columns]
    for c in missing:
        name, kind = c.split()
        mail = mail.withColumn(name, F.lit(None).cast(kind))
    mail = mail.withColumn("has_list_unsubscribe", F.lit(False)).select(*[c.split()[0] for c in MESSAGES.split(", ")]).cache()
    root, limits = str(tmp_path), {"window_seconds": 10 * 3600}
    for b in (0, 1, 1):
        ingest.ingest_batch(spark, mail.where(F.pmod(F.xxhash64("dedup_key"), F.lit(2)) == b), root, b)
        ingest.rethread_batch(spark, root, b, **limits)
        ingest.reindex_batch(spark, root, b)
    kept = spark.read.parquet(f"{root}/messages").drop("batch")
    whole = threads.assign_threads(kept, **limits)
    assert {tuple(r) for r in ingest.current_threads(spark, root).collect()} == {tuple(r) for r in whole.collect()}
    chunks = chunked("thread_aware", kept.join(whole, "dedup_key"), F.col("body_new"), ["date_utc"]).select(F.col("chunk_id").alias("id"), "text")
    asked = chunks.limit(5).select(F.monotonically_increasing_id().alias("qid"), F.col("text").alias("query")).cache()
    assert run(segments.search(spark, f"{root}/segments", asked, 5)[0]) == run(lexical.bm25(chunks, asked, 5, keep_zero=False))


EVENT = "id long, key string, ts timestamp, order_key string"


def _steps(spark, tmp_path, batches, schema, build):
    """Runs a stream over files that come one after the other, restarted from its checkpoint for each."""
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def _at(hour):
    import datetime

    return datetime.datetime(2020, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(hours=hour)


def test_first_copies_across_restarts(spark, tmp_path):
    """State outlives restarts; a copy within the limit is dropped, one long after it is first again."""
    batches = [
        [(1, "a", _at(0), "1"), (2, "b", _at(1), "2"), (3, "a", _at(1), "3")], [(4, "a", _at(5), "4"), (5, "c", _at(6), "5")],
        [(6, "b", _at(9), "6"), (7, None, _at(9), "7"), (8, "d", None, "8")], [(9, "x", _at(200), "9")], [(10, "a", _at(201), "a"), (11, "a", _at(202), "b"), (12, "x", _at(203), "c")],
    ]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        out = _steps(spark, tmp_path, batches, EVENT, lambda s: state.first_copies(s, "key", "order_key", "ts", 12 * 3600))
        assert sorted(r["id"] for r in out.collect()) == [1, 2, 5, 7, 9, 10]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_joined_streams_across_restarts(spark, tmp_path):
    schema = "id long, key string, ts timestamp"
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", None]), _at(i / 4)) for i in range(200)]
    batches = [rows[i : i + 50] for i in range(0, 200, 50)] + [[(1000, "z", _at(500)), (1002, "z", _at(500))], [(1003, "z", _at(900)), (1005, "z", _at(900))]]

    def build(s):
        return pairs.followed(s.where("id % 3 = 0"), s.where("id % 3 <> 0"), "key", "ts", "2 HOURS")

    got = {(r["id"], r["next_id"]) for r in _steps(spark, tmp_path, batches, schema, build).collect()}
    table = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {(r["id"], r["next_id"]) for r in build(table).collect()}
    assert {p for p in got if p[0] < 1000} == {p for p in want if p[0] < 1000} and any(p[1] is None for p in got)


def test_sketches(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    days = sketches.daily(e.unionByName(e.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))), "ts", ["event_type"], "user_id", "value")
    whole = sketches.merged(days, F.lit(0), ["event_type"]).collect()
    for r in whole:
        own = e.where(F.col("event_type") == r["event_type"])
        assert r["n"] == own.count()
        assert abs(r["distinct"] - own.select("user_id").distinct().count()) <= 0.05 * r["distinct"] + 1
    worst = sketches.rank_errors(sketches.merged(days, F.lit(0), ["event_type"]), e, F.lit(0), ["event_type"], "value", 0.9).agg(F.max("rank_error")).first()[0]
    assert worst <= 0.03
    assert sketches.merged(days.limit(0), F.lit(0), ["event_type"]).count() == 0


def test_progress_rows(spark, tmp_path):
    seen = []
    listener = observed.Progress(seen.append)
    spark.streams.addListener(listener)
    try:
        _steps(spark, tmp_path, [[(i, "a", _at(i))] for i in range(3)], "id long, key string, ts timestamp", lambda s: s)
        import time

        for _ in range(50):
            if sum(r["rows"] for r in seen) == 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sum(r["rows"] for r in seen) == 3 and listener.table(spark).count() == len(seen) >= 3


def test_words_of_a_text_are_those_of_the_expression(spark, tmp_path):
    """Odd letters, digits, lone letters, stop words, empty texts beside others; ids that are there twice, one null."""
    import pyarrow as pa

    texts = ["The red_1 É ÉCOLE x y2", "", "a", "İstanbul ΣΑΣ K9 K", "of the", "end", "start_", "_", "9 99 the99", " lead trail ", "tab\tnew\nline--dash", "ß"] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    want = {r["id"]: r["t"] for r in rows.select("id", lexical.terms(F.col("text")).alias("t")).collect()}
    low = rows.select(F.col("id").cast("string"), F.lower("text").alias("text")).orderBy("id").toArrow().combine_chunks().to_batches()[0]
    for batch in (low, low.slice(3, 7), low.slice(1, 1)):
        got = [r for b in segments._read_words(iter([batch])) for r in b.to_pylist()]
        assert [r["id"] for r in got] == batch.column(0).to_pylist()
        for r in got:
            assert dict(zip(r["terms"], r["tfs"])) == {w: want[int(r["id"])].count(w) for w in want[int(r["id"])]} and r["dl"] == len(want[int(r["id"])])
    assert segments._worded(pa.array([], pa.string()))[0].size == 0
    changes = [("1", "red cat", False), ("1", "red dog", False), ("2", "cat", False), ("2", "zoo", True), (None, "owl", False), (None, "owl cat", False)]
    segments.apply(spark.createDataFrame(changes, "id string, text string, gone boolean"), str(tmp_path))
    docs = {r["id"]: sorted(r["terms"]) for r in spark.read.parquet(f"{tmp_path}/docs").collect()}
    assert docs == {"1": ["dog", "red"], None: ["cat", "owl"]}


def test_blocks_are_whole_however_many_postings_are_held(monkeypatch):
    import pyarrow as pa

    rows = [(f"{s}{i}", 3 + i, ["red", f"w{s}", "cat"][: 1 + i], [1 + i, 2, 1][: 1 + i], s) for s in range(6) for i in range(3)] + [("6", 0, [], [], 6)]
    cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64()))]
    batch = pa.RecordBatch.from_arrays(cols, names=["id", "dl", "terms", "tfs", "stripe"])
    want = {}
    for i, dl, terms, tfs, s in rows:
        for t, tf in zip(terms, tfs):
            want.setdefault((t, s), []).append({"id": i, "tf": tf, "dl": dl})
    for held in (1, 13, 1000):
        monkeypatch.setattr(segments, "HELD", held)
        got = [r for b in segments._packed(batch.slice(a, 1) for a in range(len(batch))) for r in b.to_pylist()]
        assert len(got) == len(want) and {(r["term"], r["stripe"]): r["items"] for r in got} == want
        assert all((r["n"], r["tf_max"], r["dl_min"]) == (len(r["items"]), max(x["tf"] for x in r["items"]), min(x["dl"] for x in r["items"])) for r in got)
    assert [(r["term"], r["stripe"]) for r in got] == sorted(want)


def test_a_scan_is_the_search(spark, tmp_path, monkeypatch):
    """Living rows alone, with words that the tasks know and with all of them, in segments of several parts."""
    monkeypatch.setattr(segments, "PACKED", 40)
    root, now = str(tmp_path), {str(i): f"red w{i % 7} " + "cat " * (i % 5) for i in range(90)}
    segments.apply(spark.createDataFrame([(i, t, False) for i, t in now.items()], "id string, text string, gone boolean"), root, fan=2)
    segments.apply(spark.createDataFrame([("3", "red red", False), ("4", None, True), ("new", "w1 cat", False)], "id string, text string, gone boolean"), root, fan=2)
    now |= {"3": "red red", "new": "w1 cat"}
    del now["4"]
    asked = spark.createDataFrame([(1, "red cat"), (2, "w1 w1 cat"), (3, "none"), (4, None)], "qid int, query string")
    want = run(lexical.bm25(spark.createDataFrame(list(now.items()), "id string, text string"), asked, 6, keep_zero=False))
    assert run(segments.search(spark, root, asked, 6)[0]) == want
    for known in (0, 100):
        monkeypatch.setattr(segments, "KNOWN", known)
        assert run(segments.scan(spark, root, asked, 6)) == want
    assert segments.scan(spark, f"{root}/none", asked, 6).count() == 0


def test_what_would_be_merged_at_once_is_written_once(spark, tmp_path):
    """The second of two like batches takes the first in: two segments are written, not three; rows replaced or removed by it are gone."""
    root = str(tmp_path)
    batch = lambda a, b, *more: spark.createDataFrame([(str(i), f"red w{i % 3}", False) for i in range(a, b)] + list(more), "id string, text string, gone boolean")
    segments.apply(batch(0, 40), root, fan=2)
    segments.apply(batch(40, 78, ("3", "blue", False), ("4", None, True)), root, fan=2)
    assert len(list(tmp_path.glob("postings/segment=*"))) == len(list(tmp_path.glob("docs/segment=*"))) == 2
    assert [(r["kind"], r["n"]) for r in segments._manifest(spark, root)] == [("segment", 77)]
    asked = spark.createDataFrame([(1, "blue red"), (2, "w1")], "qid int, query string")
    now = {str(i): f"red w{i % 3}" for i in range(78) if i != 4} | {"3": "blue"}
    assert run(segments.scan(spark, root, asked, 90)) == run(lexical.bm25(spark.createDataFrame(list(now.items()), "id string, text string"), asked, 90, keep_zero=False))
