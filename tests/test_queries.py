"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from postquill.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(float(v)) if type(v).__name__ == "Decimal" else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in got.toArrow().to_pylist())
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall())
    assert cols == sorted(names)
    assert mine == want


def test_queries_without_sql_run(spark, sf):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["qid", "id", "score", "rank"] and out.count() > 0
    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries())


def test_all_query_vectors_are_answered(spark, sf):
    """Every id divisible by 20, however many vectors there are: 25 of the 500 here."""
    want = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()}
    assert len(want) == 25
    for name in ("dense_topk", "dense_topk_batch", "rrf_fusion", "per_query_found_at"):
        assert {r[0] for r in QUERIES[name](spark, sf).select("qid").distinct().collect()} == want
    assert QUERIES["recall_mrr_ndcg"](spark, sf).where("query_class = 'all'").first()["n_queries"] == 25
    assert QUERIES["multi_query_fusion"](spark, sf).select("qid").distinct().count() == 13


def test_dense_search_with_odd_vectors(spark):
    """Null, empty, ragged and non-finite vectors; ids of any type; no vectors at all."""
    from postquill.operators import dense

    rows = [("a", [1.0, 0.0]), ("b", None), ("c", []), ("d", [1.0, None]), ("e", [0.5, 0.5]), ("f", [1.0, 0.0, 0.0]), ("g", [float("nan"), 1.0]), ("h", [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0, 2.0])], "qid int, vector array<float>")
    got = [tuple(r)[0:1] + tuple(r)[2:] for r in dense.search_batch(v, q, 2, block_rows=2).orderBy("qid", "rank").collect()]
    assert got == [(1, "a", 1.0, 1), (1, "h", 1.0, 2), (3, "f", 0.0, 1)]
    assert dense.search_batch(v.limit(0), q, 2).count() == 0 == dense.search_batch(v, q.limit(0), 2).count()


def test_ann_recall(spark):
    """Of the index with codes, over all query vectors, with a quarter of the vectors read at most."""
    got = QUERIES["ann_recall"](spark, "/root/testdata/sf0.1").first()
    print("ann recall", got)
    assert got["mean_recall"] >= 0.95 and got["rows_read"] <= 0.25


def test_unknown_retriever(spark):
    from postquill.operators.retrievers import retrieve

    with pytest.raises(ValueError, match="unknown retriever"):
        retrieve("other", None, None)


def test_inverted_file_without_codes(spark, sf):
    from postquill.operators import dense
    from postquill.plans.base import label_vectors

    v = label_vectors(spark, sf)
    q = v.where("id % 20 = 0").select(v.id.alias("qid"), v.embedding.alias("vector"))
    placed, centres = dense.ivf_build(v)
    exact, near = (r.groupBy("qid").agg({"id": "collect_set"}).toPandas().set_index("qid").iloc[:, 0] for r in (dense.search_batch(v, q, 20), dense.ivf_search(placed, centres, q, 20, 12)))
    got = [len(set(exact[i]) & set(near[i])) / len(exact[i]) for i in exact.index]
    assert len(got) == 25 and sum(got) / 25 >= 0.9


def test_every_document_meets_every_item(spark, tmp_path):
    """More items than 40, a null text and an item without terms."""
    spark.createDataFrame([(i, f"word{i} common the", None) for i in range(60)] + [(60, "the", None)], "item_id long, text string, x string").drop("x").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "word59 word3"), (41, "common common"), (2, None), (2, "word7 common")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["term_overlap_all"](spark, str(tmp_path)).collect()]
    assert len(got) == 4 * 61
    some = {(d, i): o for d, i, o in got if d != 2}
    assert some[1, 59] == some[1, 3] == some[41, 59] == 0.5 and some[1, 4] == some[1, 60] == 0
    assert sorted(o for d, i, o in got if d == 2 and i == 7) == [0, 1]
