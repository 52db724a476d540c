"""Stages of the pipeline on odd rows: nulls, empty and long texts, repeated rows, clashing columns, no rows."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as cp

CLASH = ("n_removed", "size", "source_size", "target", "taken", "class_id", "bands", "score")


def _docs(spark, sf):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(70)
    rows = [(10_000 + i, prose(80), None, f"s{i % 3}", None) for i in range(20)]
    rows += [(10_100 + i, f"{prose(40)} {passage} {prose(40)}", "en", "s0", 1) for i in range(4)]
    rows += [(10_200, None, None, None, None), (10_201, "", "en", "s1", 0), (10_202, " \n", "en", "s1", 2), rows[0], rows[0], (None, prose(90), "en", "s1", 1), (None, rows[1][1], "en", "s2", 1), (10_203, prose(9000), "fr", None, 5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    whole = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd)
    return whole.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASH}), passage


def test_stages_with_odd_rows(spark, sf):
    docs, passage = _docs(spark, sf)
    now = docs
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, now, sf).cache()
        assert after.columns == docs.columns, name
        own = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
        assert all(after.where(F.col(c) != F.concat(F.lit(f"{c} of "), own)).count() == 0 for c in CLASH), name
        if name == "near_duplicates":
            assert after.count() == after.select("text").distinct().count()
            assert after.where("doc_id = 10000").count() == min(1, now.where("doc_id = 10000").count())
            named = now.where("doc_id is not null").select("text")
            assert after.where("doc_id is null").count() == now.where("doc_id is null").join(named, "text", "left_anti").count()
            assert after.where("text is null or text = ''").count() <= 1
        if name == "repeated_passages":
            of = "doc_id >= 10100 and doc_id < 10104"
            assert after.where(F.contains("text", F.lit(passage))).count() == min(1, now.where(of).count())
            assert after.where(of).count() == now.where(of).count()
        now = after
    packed = cp.pack_sequences(spark, now, sf)
    rows = packed.collect()
    kept = [r["text"] for r in now.collect() if r["text"] is not None]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) and sum(r["length"] for r in rows) >= len(kept)
    assert all(re.search(r"\S", t) for t in kept)


def test_no_documents(spark, sf):
    now = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        now = stage(spark, now, sf)
        assert now.count() == 0, name
