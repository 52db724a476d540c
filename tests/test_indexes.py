"""Kept indexes, versions of tables and mailboxes read in batches."""

import pytest
from pyspark.sql import functions as F

from postquill.operators import dense, indexes, lexical, retrievers
from postquill.sources import mailbox, versions

DEMO = "postquill.sources.mailbox:DemoMailbox"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert versions.current(spark, root) is None and versions.read(spark, root, "id long").count() == 0
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root)
    versions.replace(spark.range(3), root)
    kept = versions.current(spark, root)
    versions.replace(versions.read(spark, root).withColumn("id", F.col("id") + 10), root)  # reads what it replaces
    assert _rows(versions.read(spark, root)) == [(10,), (11,), (12,)] and versions.current(spark, root) != kept
    spark.range(1).write.parquet(f"{root}/v-unfinished")  # a writer that died before its pointer moved
    assert _rows(versions.read(spark, root)) == [(10,), (11,), (12,)]
    assert versions.sweep(spark, root) == 2 and versions.read(spark, root).count() == 3


def test_kept_postings_give_the_same_run(spark, sf, tmp_path):
    root = f"file://{tmp_path}/bm25"
    chunks = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text").unionByName(spark.sql("SELECT 'null' AS id, CAST(null AS string) AS text"))
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    with pytest.raises(FileNotFoundError):
        indexes.search_lexical(spark, root, asked)
    at = indexes.load_or_build(chunks, root)
    assert indexes.load_or_build(chunks, root) == at  # nothing has changed
    want = _rows(lexical.bm25(chunks, asked, 20, keep_zero=False))
    assert want and _rows(indexes.search_lexical(spark, root, asked, 20)) == want
    pushed, indexes.PUSHED_TERMS = indexes.PUSHED_TERMS, 0
    try:
        assert _rows(indexes.search_lexical(spark, root, asked, 20)) == want  # terms joined instead of pushed
    finally:
        indexes.PUSHED_TERMS = pushed
    changed = chunks.withColumn("text", F.when(F.col("id") == "null", "now it has words").otherwise(F.col("text")))
    assert indexes.stale(changed, root) and indexes.load_or_build(changed, root) != at and not indexes.stale(changed, root)


def test_empty_index(spark, tmp_path):
    root = f"file://{tmp_path}/none"
    none = spark.createDataFrame([], "id string, text string")
    indexes.load_or_build(none, root)
    assert indexes.search_lexical(spark, root, spark.sql("SELECT 1 AS qid, 'word' AS query")).count() == 0


def test_vectors_are_added_once(spark, tmp_path):
    root = f"file://{tmp_path}/vectors"
    calls = spark.sparkContext.accumulator(0)

    def embed(rows, key, text):
        calls.add(rows.count())
        return dense.hashed_embedding(rows, key, text)

    a = spark.createDataFrame([("a", "red cat"), ("b", "blue dog"), ("c", None), ("a", "red cat")], "id string, text string")
    assert indexes.load_vectors(a, root).count() == 0
    indexes.store_vectors(a, root, embed, shards=3)
    assert calls.value == 3  # the wordless one has no vector
    want = _rows(dense.hashed_embedding(a.dropDuplicates(), "id"))
    assert _rows(indexes.load_vectors(a, root)) == want
    indexes.store_vectors(a.unionByName(spark.sql("SELECT 'd' AS id, 'green bird' AS text")), root, embed)
    assert calls.value == 5  # the new one, and the wordless one again
    new = spark.createDataFrame([("a", "white horse"), ("b", "blue dog")], "id string, text string")
    assert [r["id"] for r in indexes.load_vectors(new, root).collect()] == ["b"]  # the old vector of a changed text stays behind
    indexes.store_vectors(new, root, embed)
    assert _rows(indexes.load_vectors(new, root)) == _rows(dense.hashed_embedding(new, "id"))


def test_stemmed_retriever(spark):
    chunks = spark.createDataFrame([("a", "the meetings were running late"), ("b", "a cat"), ("c", None)], "id string, text string")
    asked = spark.createDataFrame([(1, "meeting run"), (2, "dogs")], "qid int, query string")
    assert [(r["qid"], r["id"], r["rank"]) for r in retrievers.retrieve("bm25_stemmed", chunks, asked).collect()] == [(1, "a", 1)]
    assert retrievers.retrieve("bm25", chunks, asked).count() == 0


def test_mailbox(spark):
    ids = mailbox.list_ids(spark, DEMO, page=4)
    assert sorted(r[0] for r in ids.collect()) == [f"demo/inbox/{i}" for i in range(10)]
    assert mailbox.list_ids(spark, DEMO, page=4, most=6).count() == 6 and mailbox.list_ids(spark, DEMO, most=0).count() == 0
    got = {r["source_path"]: r for r in mailbox.fetch(ids, DEMO, 3).collect()}
    assert len(got) == 10 and got["demo/inbox/7"]["content"] is None and got["demo/inbox/7"]["problem"] == "OSError: gone"
    assert b"<m4@demo>" in got["demo/inbox/4"]["content"] and got["demo/inbox/4"]["problem"] is None
    assert mailbox.starting_point(DEMO, None) == (0, 10, True)
    assert mailbox.starting_point(DEMO, 2) == (0, 10, True) and mailbox.starting_point(DEMO, 5) == (5, 10, False)
