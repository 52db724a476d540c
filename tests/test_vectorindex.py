"""The vector index with codes against exact search and plain arithmetic."""

import numpy as np

from postquill.operators import dense, vectorindex
from postquill.plans.base import label_vectors, vector_queries


def run(df):
    return sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in df.collect())


def test_tables_sum_to_the_product_with_the_decoded_vector():
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(300, 12)), rng.normal(size=(5, 12))
    book = vectorindex.train(x, cells=4, parts=3, words=16)
    cell, code = book.place(x)
    table = book.tables(q)
    decoded = book.centres[cell] + np.concatenate([book.words[m][code[:, m]] for m in range(3)], axis=1)
    score = (q @ book.centres.T)[:, cell] + sum(table[:, m][:, code[:, m]] for m in range(3))
    assert np.allclose(score, q @ decoded.T)
    assert ((x - decoded) ** 2).sum() < 0.6 * ((x - book.centres[cell]) ** 2).sum()
    assert (cell == ((x[:, None] - book.centres) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_a_short_list_of_all_is_exact_search(spark, sf, tmp_path):
    v, q = label_vectors(spark, sf), vector_queries(spark, sf)
    vectorindex.build(v, str(tmp_path), cells=5, parts=8, words=32)
    assert run(vectorindex.search(spark, str(tmp_path), q, 7, short=v.count())) == run(dense.search_batch(v, q, 7).drop("run"))
    read = vectorindex.reading(spark, str(tmp_path), q, 50, probes=2).first()
    assert read["rows_read"] <= 50 / v.count() and 0 < read["codes_read"] < 1
    few = vectorindex.search(spark, str(tmp_path), q, 7, probes=2, short=50)
    assert few.groupBy("qid").count().count() == q.count()


def test_cells_that_nothing_probes_are_not_read(spark, sf, tmp_path):
    """The short list is joined by cell, and the codes of a cell are files of their own."""
    v = label_vectors(spark, sf)
    at = vectorindex.build(v, str(tmp_path), cells=5)
    whole = spark.read.parquet(f"{at}/codes")
    assert "cell" in whole.columns and len({f.split("cell=")[1].split("/")[0] for f in whole.inputFiles()}) == 5
    assert len(whole.where("cell = 3").inputFiles()) < len(whole.inputFiles()) or "PartitionFilters: [isnotnull(cell" in whole.where("cell = 3")._jdf.queryExecution().toString()


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0, None]), (5, [0.5, 0.5]), (6, [1.0, 0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").selectExpr("*", "'clash' AS cell", "1 AS code")
    q = spark.createDataFrame([("x", [1.0, 0.0]), ("y", None), ("z", [0.0, 0.0, 2.0])], "qid string, vector array<float>")
    vectorindex.build(v, str(tmp_path / "a"), cells=2, parts=2, words=4)
    assert [(r["qid"], r["id"], r["score"]) for r in vectorindex.search(spark, str(tmp_path / "a"), q, 2).orderBy("rank").collect()] == [("x", 1, 1.0), ("x", 8, 1.0)]
    vectorindex.build(v.limit(0), str(tmp_path / "b"), cells=2, parts=2, words=4)
    assert vectorindex.search(spark, str(tmp_path / "b"), q, 2).count() == 0


def test_codes_and_vectors_meet_queries_in_tiles(spark, sf, tmp_path, monkeypatch):
    """Short lists of several groups and parts are the best of the decoded vectors; no join makes pairs."""
    for name, many in (("QUERY_GROUP", 9), ("PART_ROWS", 60), ("BLOCK", 20), ("EXACT_GROUP", 9), ("EXACT_ROWS", 100)):
        monkeypatch.setattr(vectorindex, name, many, raising=False)
    v, q = label_vectors(spark, sf), vector_queries(spark, sf)
    at = vectorindex.build(v, str(tmp_path), cells=5, parts=8, words=8)
    listed = vectorindex.short_list(spark, str(tmp_path), q, 30)
    assert "Join" not in listed._jdf.queryExecution().optimizedPlan().toString()
    _, book = vectorindex.load(spark, str(tmp_path))
    kept = spark.read.parquet(f"{at}/vectors").collect()
    stands = {r["id"]: book.centres[r["cell"]] + np.concatenate([w[c] for w, c in zip(book.words, r["code"])]) for r in kept}
    got = {r["qid"]: set(r["ids"]) for r in listed.groupBy("qid").agg({"id": "collect_set"}).toDF("qid", "ids").collect()}
    for r in q.collect():
        score = {i: float(np.dot(r["vector"], x)) for i, x in stands.items()}
        last = sorted(score.values())[-30]
        assert len(got[r["qid"]]) == 30 and all(score[i] >= last - 2e-6 for i in got[r["qid"]])
    assert run(vectorindex.search(spark, str(tmp_path), q, 7, short=v.count())) == run(dense.search_batch(v, q, 7).drop("run"))


def test_recall_takes_one_short_list(spark, sf, monkeypatch):
    from postquill.plans.registry import QUERIES

    calls, made = [], vectorindex.short_list
    monkeypatch.setattr(vectorindex, "short_list", lambda *a, **b: calls.append(1) or made(*a, **b))
    assert QUERIES["ann_recall"](spark, sf).count() == 1 and len(calls) == 1
