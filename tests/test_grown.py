"""What came to light on larger tables: letters, sentences, and searches cut into several tiles."""

from pyspark.sql import functions as F

from postquill.functions import text
from postquill.plans.registry import QUERIES


def test_capitals_letter_by_letter(spark):
    rows = spark.createDataFrame([("engeßge ü ﬁ",), ("plain é",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.plain_upper("t")).collect()] == ["ENGEßGE Ü ﬁ", "PLAIN É", "", None]


def test_arms_with_sharp_s(spark, tmp_path):
    """Sharp s has no capital of one letter: both sides still hold the same words."""
    spark.createDataFrame([(3, "engeßge keitßt")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["same_commitment_pairs"](spark, str(tmp_path)).first()["same"]
    assert QUERIES["compare_arms"](spark, str(tmp_path)).first()["both"] == 1


def test_sentences_keep_their_digits(spark):
    """The second sentence is number 1, the third number 2; neither loses that digit."""
    row = spark.sql("SELECT 'First it was agreed. 1224 were sent out on Friday 1. 22 came back on the next Friday 2' AS t")
    assert row.select(text.uncited_claims("t")).first()[0] == ["1224 were sent out on Friday 1.", "22 came back on the next Friday 2"]
    assert row.select(F.size(text.split_claims("t"))).first()[0] == 3


def test_search_in_several_tiles(spark):
    """Rows with equal and almost equal scores, cut into tiles of few queries and rows."""
    from postquill.operators import dense, tiles

    rows = [(i, [float(i * 7 % 5), (i % 3) * 1e-7]) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i % 4)]) for i in range(9)], "qid int, vector array<double>")
    want = sorted((i, *x) for i in range(9) for x in sorted(((-round(a + b * (i % 4), 6), n) for n, (a, b) in rows))[:20])
    held, tiles.HELD = tiles.HELD, 50
    try:
        got = dense.search_batch(v, q, 20, query_batch=4, block_rows=40)
        assert sorted((r["qid"], -r["score"], r["id"]) for r in got.collect()) == want
    finally:
        tiles.HELD = held


def test_a_tile_holds_no_more_than_its_bounds():
    """Scores that grow row by row are the worst case: each row enters; what is kept stays at k a query."""
    import numpy as np

    from postquill.operators import tiles

    best = tiles._Best(3, 5, -np.inf)
    held, tiles.HELD = tiles.HELD, 100
    try:
        for a in range(0, 4000, 10):
            best.add(np.arange(a, a + 10), np.arange(a, a + 10)[:, None] // 2 * np.ones(3))
            assert sum(len(x[0]) for x in best.kept) <= 200
    finally:
        tiles.HELD = held
    query, score, row = best.settle()
    assert sorted(row[query == 1].tolist())[-4:] == [3996, 3997, 3998, 3999]


def test_relevant_vectors_are_counted_not_paired(spark, tmp_path):
    """One label for all rows: no join may make their pairs."""
    spark.range(400).selectExpr("id AS vec_id", "array(float(id % 7), float(id % 5)) AS embedding", "1 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    from postquill.plans.retrieval import _vector_eval

    run, _, relevant, counts = _vector_eval(spark, str(tmp_path))
    assert relevant.count() == run.count() <= 20 * 100
    assert {r["n_relevant"] for r in counts.collect()} == {399}
    assert {r["n_relevant"] for r in QUERIES["per_query_found_at"](spark, str(tmp_path)).collect()} == {399}


def test_bm25_makes_no_pairs_in_a_join(spark):
    """Questions meet chunks in tiles: the plan that ranks them joins and adds up nothing."""
    from postquill.operators import lexical

    chunks = spark.range(50).selectExpr("id", "concat('word', id % 7, ' common text') AS text")
    asked = spark.createDataFrame([(1, "word3 common"), (2, "nothing")], "qid int, query string")
    out = lexical.bm25(chunks, asked, 3, keep_zero=False)
    assert [(r["qid"], r["id"]) for r in out.orderBy("rank").collect()] == [(1, 3), (1, 10), (1, 17)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Aggregate" not in plan


def test_bm25_with_ids_that_are_there_twice(spark):
    """Rows of one id and length are one chunk of both words, others of that id add up; so is a null id's."""
    import math

    from postquill.operators import lexical, tiles

    rows = [(1, "red red cat"), (1, "red dog owl"), (1, "red"), (2, "red cat"), (3, "owl"), (None, "cat"), (4, None)]
    asked = spark.createDataFrame([(i, "red cat red") for i in range(5)], "qid int, query string")
    n, avgdl = 7, 11 / 7
    idf = {"red": math.log(1 + (n - 3 + 0.5) / 3.5), "cat": math.log(1 + (n - 3 + 0.5) / 3.5)}
    part = lambda w, tf, dl: (2 if w == "red" else 1) * idf[w] * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    want = {1: part("red", 3, 3) + part("cat", 1, 3) + part("red", 1, 1), 2: part("red", 1, 2) + part("cat", 1, 2), None: part("cat", 1, 1)}
    held, tiles.HELD = tiles.HELD, 3
    try:
        got = lexical.bm25(spark.createDataFrame(rows, "id int, text string"), asked, 9, keep_zero=False).collect()
    finally:
        tiles.HELD = held
    assert {(r["qid"], r["id"]): r["score"] for r in got} == {(q, i): round(s, 6) for q in range(5) for i, s in want.items()}


def test_segments_count_words_where_the_text_is():
    """Terms of a row with their numbers, in a batch with an empty row; no row leaves its place."""
    import pyarrow as pa

    from postquill.operators import segments

    rows = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([["red", "cat", "red"], [], ["owl", "cat"]], pa.list_(pa.string()))], names=["id", "tokens"])
    got = [(r["id"], r["dl"], dict(zip(r["terms"], r["tfs"]))) for b in segments._counted(iter([rows])) for r in b.to_pylist()]
    assert got == [("a", 3, {"red": 2, "cat": 1}), ("b", 0, {}), ("c", 2, {"owl": 1, "cat": 1})]


def test_bounds_open_stripes_for_their_questions():
    """Two questions, two stripes: a stripe is open to the question whose edge its bound reaches."""
    import pyarrow as pa

    from postquill.operators import segments

    names = ["tile", "size", "kind", "qid", "id", "words", "values"]
    cols = [[0] * 4, [0] * 4, [0, 0, 1, 1], [1, 2, None, None], [None, None, "s:0", "s:1"], ["cat\x1fred", "cat", "cat", "cat\x1fowl\x1fred"], [[1.0, 2.0, 1.5], [1.0, 9.0], [0.5, 7.0], [0.5, 0.1, 0.9, 3.0, 8.0, 4.0]]]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
    got = [tuple(r.values()) for b in segments._opened(iter([batch])) for r in b.to_pylist()]
    assert got == [(None, "s:1", None, None), (1, None, 7, 14), (2, None, 0, 10)]
