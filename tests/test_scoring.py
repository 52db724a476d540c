"""Passages scored in batches by a loaded scorer."""

from pyspark.sql import functions as F

from postquill.operators import rerank, scoring

PAIRS = [(q, f"p{i}", "red green", None if i == 5 else "blue " * i + "red") for q in (1, 2) for i in range(20)]


def pairs(spark):
    return spark.createDataFrame(PAIRS, "qid int, id string, query string, text string")


def lengths():
    def score(queries, passages):
        assert len(queries) <= 4
        return [[float(len(p.split())), float(len(q.split()))] for q, p in zip(queries, passages)]

    return score


def test_batches_of_like_lengths(spark):
    got = scoring.score_pairs(pairs(spark).coalesce(1), lengths, batch=4).collect()
    assert len(got) == 38 and {r["id"] for r in got} == {f"p{i}" for i in range(20)} - {"p5"}
    by_batch = {}
    for r in got:
        by_batch.setdefault((r["task"], r["batch"]), []).append(r)
    for (task, n), rows in by_batch.items():
        assert len(rows) == rows[0]["batch_rows"] <= 4 and len({r["batch_ms"] for r in rows}) == 1 and rows[0]["batch_ms"] >= 0
        later = by_batch.get((task, n + 1))
        assert later is None or max(r["logits"][0] for r in rows) <= min(r["logits"][0] for r in later)
    assert all(r["logits"][0] == int(r["id"][1:]) + 1 for r in got)


def test_a_passage_is_read_to_its_limit(spark):
    got = scoring.score_pairs(pairs(spark), lengths, batch=4, max_tokens=3).collect()
    assert max(r["logits"][0] for r in got) == 3 and min(r["logits"][0] for r in got) == 1


def test_times_add_up(spark):
    scored = spark.createDataFrame([(1, "a", 0, 0, 2, 6.0), (2, "b", 0, 0, 2, 6.0), (1, "c", 0, 1, 1, 5.0)], "qid int, id string, task int, batch int, batch_rows int, batch_ms double")
    assert {tuple(r) for r in scoring.times(scored).collect()} == {(1, 2, 8.0), (2, 1, 3.0)}


def test_token_similarity_by_hand():
    score = scoring.token_similarity()
    # ab and abc share 2 of 3 letters; cd and abc 1 of 4, cd and de 1 of 3
    assert score(["ab cd", "", "ab"], ["abc DE", "ab", "x"]) == [[0.499999], [0.0], [0.0]]


def test_batched_rerank_keeps_the_tail(spark):
    p = pairs(spark)
    runs = p.select("qid", F.lit("bm25").alias("run"), "id", F.lit(1.0).alias("score"), (F.substring("id", 2, 9).cast("int") + 1).alias("rank"))
    texts = p.where("qid = 1").select("id", "text")
    run, times = rerank.rerank_batched(runs, p.select("qid", "query").distinct(), texts, 10, lengths, batch=4)
    want = [f"p{i}" for i in (9, 8, 7, 6, 4, 3, 2, 1, 0)]  # logits: question less passage
    for q in (1, 2):
        rows = run.where(f"qid = {q}").orderBy("rank").collect()
        assert [r["id"] for r in rows] == want[::-1] + ["p5"] + [f"p{i}" for i in range(10, 20)]
        assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert {(r["qid"], r["passages"]) for r in times.collect()} == {(1, 9), (2, 9)}
    assert run.limit(0).count() == 0


def test_no_pairs(spark):
    assert scoring.score_pairs(pairs(spark).limit(0), lengths).count() == 0
